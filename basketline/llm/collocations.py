"""Phrases whose words occur together more often than apart, per language, found by Rabin-Karp fingerprints.

1. Texts are cut into pieces and words and laid out in blocks of one language: words separated by one
   space, pieces by a line feed.
2. Prefix polynomials give the fingerprint of every n-gram of a block at once. A block counts its own
   n-grams, after comparing each occurrence with the first one of its fingerprint byte by byte, and sends
   one entry a different n-gram, packed: fingerprint, count and a pointer to an occurrence.
3. Entries meet in buckets of fingerprints. Only fingerprints that are frequent in sum send their
   pointers back to the blocks, which materialise these texts.
4. Counts are added up again by text, so that two phrases that share a fingerprint come apart.
5. Scores, the rule on longer phrases and the ranking are joins over frequent phrases.

A frequent n-gram is one entry a block, however often it occurs. Buckets hold a bounded number of blocks'
shares, so neither blocks nor buckets grow with the corpus.

Defined results: a null text is empty, a null language is `und`; rows without a doc_id take part, as do
repeated rows, each as often as it is there; equal scores and counts are ordered by phrase; other columns
are ignored; a language without candidates, or an empty table, gives no rows. A piece without any of the
break characters is never cut, so it is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.llm.common import written
from basketline.llm.rolling import Prefixes, differing, ragged
from basketline.llm.text import LOWER, mix, raw, slices

MOST_WORDS, LEAST_COUNT, REPORT = 3, 10, 2000
PARTS_PER_MILLION, COVERED_PERCENT = 1_000_000, 50
BLOCK_BYTES = 2_000_000
SLICE = 1 << 18  # bytes of text laid out at once
BLOCKS_A_BUCKET = 3
BITS = 48

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = np.zeros(256, bool)
GAP[[32, 9]] = True


def laid_out(texts: pa.Array) -> tuple[np.ndarray, int]:
    """(bytes, number of words): lower-cased words, each followed by a space or, at the end of a piece, a line feed."""
    offsets, data = raw(texts)
    inside = ~(BREAK | GAP)[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[0] = True
    begins[1:-1] = ~inside[:-1]
    begins[offsets] = True
    starts = np.flatnonzero(inside & begins[:-1])
    if not len(starts):
        return np.zeros(0, np.uint8), 0
    word = np.cumsum(inside)
    ends = np.append(word[starts[1:]] - 1, word[-1])  # word bytes before the next word
    piece = np.cumsum(BREAK[data])[starts]
    text = np.searchsorted(offsets, starts, "right")
    goes_on = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    out = np.empty(int(word[-1]) + len(starts), np.uint8)
    marks = ends + np.arange(len(starts))
    rest = np.ones(len(out), bool)
    rest[marks] = False
    out[rest] = LOWER[data[inside]]
    out[marks] = np.append(np.where(goes_on, 32, 10), 10)
    return out, len(starts)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, lang, words, data: the texts of a task, laid out, in blocks of one language.

    Data is compressed, see layout(): Spark hands a task's blocks to Python together, which opens one at a time.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 33

        def block(lang: str, data: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            words = int(((data == 32) | (data == 10)).sum())
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "lang": [lang], "words": pa.array([words], pa.int64()),
                                               "data": pa.array([zstandard.ZstdCompressor(1).compress(data)], pa.binary())})

        for batch in batches:
            for part, texts in slices(batch, limit=min(SLICE, block_bytes)):
                langs = part.column("lang").dictionary_encode()
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    data, n = laid_out(texts.filter(pa.array(langs.indices.to_numpy() == i)))
                    if not n:
                        continue
                    held.setdefault(lang, []).append(data)
                    sizes[lang] = sizes.get(lang, 0) + len(data)
                    while sizes[lang] >= block_bytes:
                        whole = np.concatenate(held[lang])
                        stops = np.flatnonzero(whole == 10)
                        cut = int(stops[max(0, np.searchsorted(stops, block_bytes) - 1)]) + 1
                        yield block(lang, whole[:cut])
                        held[lang], sizes[lang] = [whole[cut:]], len(whole) - cut
                if sum(sizes.values()) > 4 * block_bytes:  # many languages in one task
                    yield from (block(lang, np.concatenate(held[lang])) for lang in held if sizes[lang])
                    held, sizes = {}, {}
        yield from (block(lang, np.concatenate(held[lang])) for lang in held if sizes[lang])

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(pack, "block bigint, lang string, words bigint, data binary")


def layout(data: pa.Scalar) -> np.ndarray:
    """The bytes of a block."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), np.uint8)


def grams(data: np.ndarray, lang: str, n: int, bits: int, sums: Prefixes) -> tuple[np.ndarray, ...]:
    """(fingerprints, counts, starts, lengths) of the different n-grams of a block, each with its first occurrence."""
    stops = np.flatnonzero((data == 32) | (data == 10))
    goes_on = np.concatenate([[0], np.cumsum(data[stops] == 10)])
    count = max(0, len(stops) - n + 1)
    at = np.flatnonzero(goes_on[n - 1:][:count] == goes_on[:count])  # no piece ends within the first n - 1 words
    if not len(at):  # all pieces are shorter
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    starts = np.append(0, stops[:-1] + 1)[at]
    ends = stops[at + n - 1]
    seed = Prefixes(np.frombuffer(f"{n} {lang}".encode(), np.uint8))
    salt = seed.of(np.array([0]), np.array([len(seed.sums) - 1]))
    prints = (mix(sums.of(starts, ends) ^ salt) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(prints, kind="stable")
    prints, starts, ends = prints[order], starts[order], ends[order]
    new = np.append(True, prints[1:] != prints[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    counts = np.diff(np.append(first, len(prints)))
    lengths = ends - starts
    again = np.flatnonzero(~new)
    lead = first[group[again]]
    wrong = lengths[again] != lengths[lead]
    equal = ~wrong
    wrong[equal] = differing(data, starts[again[equal]], starts[lead[equal]], lengths[again[equal]])
    out = [prints[first], counts, starts[first], lengths[first]]
    if wrong.any():  # groups in which different n-grams share a fingerprint
        mixed = np.unique(group[again[wrong]])
        found: dict[tuple[int, bytes], list[int]] = {}
        for i in np.flatnonzero(np.isin(group, mixed)):
            key = (int(prints[i]), data[starts[i]:ends[i]].tobytes())
            found.setdefault(key, [0, int(starts[i])])[0] += 1
        pure = np.delete(np.arange(len(first)), mixed)
        more = [[p for p, _ in found], [c for c, _ in found.values()], [s for _, s in found.values()], [len(t) for _, t in found]]
        out = [np.concatenate([x[pure], np.array(m, np.int64)]) for x, m in zip(out, more)]
    return tuple(x.astype(np.int64) for x in out)


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of equally many non-negative numbers, compressed byte plane by byte plane."""
    planes = [np.ascontiguousarray(c.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(1).compress(b"".join(planes))


def unpacked(data: bytes, n_columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(n_columns, 8, -1)
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes]


def entries(rows: DataFrame, buckets: int, most_words: int, bits: int) -> DataFrame:
    """bucket, block, entries: what each block knows of the fingerprints of a bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, data in zip(*(batch.column(c) for c in ("block", "lang", "data"))):
                data = layout(data)
                sums = Prefixes(data)
                for n in range(1, most_words + 1):
                    columns = grams(data, lang.as_py(), n, bits, sums)
                    bucket = columns[0] % buckets
                    order = np.lexsort((columns[0], bucket))
                    columns, bucket = [c[order] for c in columns], bucket[order]
                    bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else [0]
                    out = []
                    for lo, hi in zip(bounds[:-1], bounds[1:]):
                        prints = columns[0][lo:hi]
                        out.append(packed([np.diff(prints, prepend=0), *(c[lo:hi] for c in columns[1:])]))
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array(bucket[bounds[:-1]] if len(bucket) else [], pa.int64()),
                        "block": pa.array([block.as_py()] * len(out), pa.int64()), "entries": pa.array(out, pa.binary())})

    return rows.select("block", "lang", "data").mapInArrow(count, "bucket bigint, block bigint, entries binary")


def frequent_pointers(found: DataFrame, least: int) -> DataFrame:
    """block, pointers: where each block has a phrase whose fingerprint is frequent, and how often."""
    def merge(table: pa.Table) -> pa.Table:
        parts = [unpacked(e.as_buffer().to_pybytes(), 4) for e in table["entries"]]
        prints = np.concatenate([np.cumsum(p[0]) for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        order = np.argsort(prints, kind="stable")
        ordered = prints[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        total = np.add.reduceat(counts[order], first)
        kept = np.zeros(len(prints), bool)
        kept[order] = np.repeat(total >= least, np.diff(np.append(first, len(prints))))
        out, at = {"block": [], "pointers": []}, 0
        for block, part in zip(table["block"].to_pylist(), parts):
            own = kept[at:at + len(part[0])]
            at += len(part[0])
            if own.any():
                out["block"].append(block)
                out["pointers"].append(packed([part[2][own], part[3][own], part[1][own]]))
        return pa.table({"block": pa.array(out["block"], pa.int64()), "pointers": pa.array(out["pointers"], pa.binary())})

    return found.groupBy("bucket").applyInArrow(merge, "block bigint, pointers binary")


def texts_of(rows: DataFrame, pointers: DataFrame) -> DataFrame:
    """lang, phrase, f: the texts that the pointers of each block name, with the block's counts."""
    def read(block: pa.Table, named: pa.Table) -> pa.Table:
        if not block.num_rows or not named.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "f": pa.array([], pa.int64())})
        data = layout(block["data"][0])
        starts, lengths, counts = (np.concatenate(c) for c in zip(*(unpacked(p.as_buffer().to_pybytes(), 3) for p in named["pointers"])))
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        phrases = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[ragged(starts, lengths)])])
        return pa.table({"lang": pa.array([block["lang"][0].as_py()] * len(starts), pa.string()), "phrase": phrases, "f": pa.array(counts, pa.int64())})

    return (rows.select("block", "lang", "data").groupBy("block").cogroup(pointers.groupBy("block"))
            .applyInArrow(read, "lang string, phrase string, f bigint"))


def n_words(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def frequent_phrases(rows: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, bits: int = BITS) -> DataFrame:
    """lang, phrase, words, f of all phrases of 1 to most_words words that occur least times; rows are written blocks()."""
    buckets = max(1, rows.count() // BLOCKS_A_BUCKET)
    pointers = written(frequent_pointers(entries(rows, buckets, most_words, bits), least), "phrase-pointers")
    counted = texts_of(rows, pointers).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return counted.withColumn("words", n_words(F.col("phrase")))


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of phrases of two or more words, by their lowest-scoring cut."""
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("n"))
    cut = (phrases.where("words > 1").withColumnRenamed("f", "a")
           .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
           .withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)")))
    both = (cut.join(parts.select("lang", F.col("part").alias("first"), F.col("n").alias("l")), ["lang", "first"])
            .join(parts.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]))
    exact = F.expr(f"(cast({PARTS_PER_MILLION} as decimal(7)) * cast(a as decimal(15)) * cast(a as decimal(15)))"
                   " div (cast(l as decimal(15)) * cast(r as decimal(15)))")
    lowest = F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "words", "a").agg(lowest).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def not_covered(candidates: DataFrame) -> DataFrame:
    """Without the candidates that a longer one contains at least COVERED_PERCENT as often."""
    word = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(word, i, m), " "))))
    longer = (candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("of"))
              .groupBy("lang", "phrase").agg(F.max("of").alias("of")))
    kept = F.col("of").isNull() | (100 * F.col("of") < COVERED_PERCENT * F.col("a"))
    return candidates.join(longer, ["lang", "phrase"], "left").where(kept).drop("of")


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, report: int = REPORT,
                 block_bytes: int = BLOCK_BYTES, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `report` phrases of each language."""
    rows = written(blocks(docs, block_bytes), "phrase-blocks")
    phrases = written(frequent_phrases(rows, most_words, least, bits), "phrases")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    top = not_covered(scored(phrases)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= report)
    words = rows.groupBy("lang").agg(F.sum("words").alias("n"))
    return top.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
                                          F.col("score").cast("bigint").alias("score"))
