"""Removal of repeated passages: every byte covered by a string of `length` bytes that starts anywhere else too.

Suffixes are ordered only as deep as `length` bytes, by radix passes from the most significant digit on.
A pass splits the groups of the pass before by one more stretch of bytes, and groups of one drop out:
their strings occur once. The groups of the last pass are exactly the repeated strings.

To order few suffixes instead of one a byte, each string of `length` bytes is led by the `gram` bytes in
it with the least hash (the rightmost of equal ones), found by a sliding minimum. Equal strings are led
by equal grams at the same place, so only suffixes that start at leading grams enter the first pass, with
the run of strings they lead. The digits are

1. the gram itself: what no other leading suffix starts with is unique, and so are all strings it leads;
2. the whole stretch of its run: where a run occurs again as it is, all of its strings are repeated, and one
   row stands for all of its copies from here on;
3. for the other runs, the bytes that up to BLOCK consecutive strings have in common;
4. the strings of the blocks that are left.

Digits are 64-bit fingerprints below the digit before (128 bits in all). No pair of suffixes is made; a
group of any size is one row of counts per task and then joined by its key, which Spark splits if it is
hot. Texts are read whole; the spans come back to them by doc_id and a digest of the text.

Defined results: a null text is empty; matches never cross documents; rows without a doc_id take no part;
repeated rows, and rows that share a doc_id, are documents of their own; texts shorter than `length` are
kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import Scratch, documents
from basketline.llm.rolling import Prefixes, ragged
from basketline.llm.text import mix, raw, slices

LENGTH = 200
BLOCK = 16
LOW = np.uint64(32)
LAST = np.uint64((1 << 32) - 1)


def block_of(length: int) -> int:
    return max(1, min(BLOCK, length // 8))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values."""
    padded = np.concatenate([values, np.full(-len(values) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(padded, axis=1).ravel()
    n = len(values) - width + 1
    return np.minimum(ahead[:n], behind[width - 1:width - 1 + n])


def runs(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, gram, stretch, first, last, place) of each run of strings led by the same gram.

    gram and stretch are fingerprints, first and last the starts of the run's strings in the slice and
    place the gram's start.
    """
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = Prefixes(data)
    at = np.arange(len(data) - gram + 1)
    prints = sums.of(at, at + gram)
    least = sliding_minimum(prints >> LOW << LOW | (LAST - at.astype(np.uint64)), length - gram + 1)
    lead = (LAST - (least & LAST)).astype(np.int64)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = ragged(offsets[:-1], sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    lead = lead[starts]
    new = np.append(True, (lead[1:] != lead[:-1]) | (text[1:] != text[:-1]))
    at = np.flatnonzero(new)
    first, last, place = starts[at], starts[np.append(at[1:], len(starts)) - 1], lead[at]
    shape = ((place - first) << 32 | (last - first)).astype(np.uint64)
    stretch = mix(sums.of(first, last + length) ^ mix(shape))
    return text[at], prints[place], stretch, first, last, place


def led_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, digest, gram, stretch, first, size, place: a row per run; size strings, the gram `place` bytes behind the first start."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                offsets, data = raw(texts)
                text, prints, stretch, first, last, place = runs(offsets, data, length, gram)
                ids, digests = (part.column(c).take(pa.array(text)) for c in ("doc_id", "digest"))
                yield pa.RecordBatch.from_arrays(
                    [ids, digests, pa.array(prints.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(first - offsets[text]),
                     pa.array(last - first + 1), pa.array(place - first)],
                    ["doc_id", "digest", "gram", "stretch", "first", "size", "place"])

    return docs.mapInArrow(find, "doc_id bigint, digest bigint, gram bigint, stretch bigint, first bigint, size bigint, place bigint")


def in_groups(rows: DataFrame, digit: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows whose digit occurs more than once; the groups are a table, so that Spark can split the join of a hot one."""
    groups = rows.groupBy(*digit).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(scratch.write(groups, name), digit, "left_semi")


def repeated_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, digest, start, end: overlapping repeated spans of docs (doc_id, text, digest), as a written table."""
    key, scratch = ["gram", "stretch"], Scratch(docs.sparkSession)
    found = scratch.write(led_runs(docs, length, gram), "suffixes")
    left = scratch.write(in_groups(found, ["gram"], scratch, "grams"), "suffixes-by-gram")
    scratch.drop("suffixes", "grams")
    one = [F.first(c).alias(c) for c in ("doc_id", "digest", "first", "size", "place")]  # any copy will do
    stretches = scratch.write(left.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *one), "suffixes-by-stretch")
    whole = left.join(stretches.where("n > 1").select(*key), key, "left_semi").select(
        "doc_id", "digest", F.col("first").alias("start"), (F.col("first") + F.col("size") - 1 + length).alias("end"))
    spans = scratch.write(whole, "repeated-stretches")
    scratch.drop("suffixes-by-gram")
    # groups of a gram that hold a run without a copy, and another run
    open_grams = stretches.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    rest = stretches.join(open_grams.select("gram"), "gram", "left_semi").select(*key, "n", "doc_id", "digest", "first", "size", "place")
    rest = scratch.write(with_bytes(rest, docs, length), "suffix-bytes")
    scratch.drop("suffixes-by-stretch")
    spans = spans.unionByName(scratch.write(parts_of_runs(rest, length, scratch), "repeated-parts"))
    scratch.drop("suffix-bytes", "blocks", "strings")
    return spans


def with_bytes(kept: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Adds `data`, the stretch of each run from the text it stands in."""
    asked = kept.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("gram", "stretch", "n", "first", "size", "place")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "digest", "gram", "stretch", "n", "first", "size", "place")
        before = None
        for batch in batches:
            for row in range(batch.num_rows):
                this = batch.column("doc_id")[row].as_py(), batch.column("digest")[row].as_py()
                if this == before:  # a repeated row; joined rows lie beside each other
                    continue
                before = this
                data = batch.column("text")[row].as_buffer()
                asked = pa.RecordBatch.from_struct_array(batch.column("asked")[row].values)
                starts = asked.column("first").to_numpy()
                lengths = asked.column("size").to_numpy() - 1 + length
                offsets = pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32))
                own = pa.py_buffer(np.frombuffer(data, np.uint8)[ragged(starts, lengths)])
                ids = [pa.repeat(batch.column(c)[row], len(starts)) for c in names[:2]]
                yield pa.RecordBatch.from_arrays([*ids, *(asked.column(c) for c in names[2:]),
                                                  pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, own])], [*names, "data"])

    return (docs.join(asked, ["doc_id", "digest"]).select("doc_id", "digest", "asked", "text")
            .mapInArrow(cut, "doc_id bigint, digest bigint, gram bigint, stretch bigint, n bigint, first bigint, size bigint, place bigint, data binary"))


def _digits(rows: pa.RecordBatch, length: int, blocks: bool) -> pa.RecordBatch:
    """A row for each block of strings, or for each string of the blocks in `wanted`, with its fingerprint."""
    block = block_of(length)
    offsets, data = raw(rows.column("data"))
    first, size, place = (rows.column(c).to_numpy() for c in ("first", "size", "place"))
    nearest, farthest = place - size + 1, place  # how far strings start before the gram
    if blocks:
        low, high = nearest // block, farthest // block
        run = np.repeat(np.arange(len(low)), high - low + 1)
        number = ragged(low, high - low + 1)
        starts = offsets[run] + place[run] - number * block
        prints = Prefixes(data).of(starts, starts + length - block + 1)
    else:
        wanted = rows.column("wanted")
        numbers = wanted.flatten().to_numpy()
        block_run = np.repeat(np.arange(len(size)), wanted.value_lengths().to_numpy())
        low = np.maximum(numbers * block, nearest[block_run])
        high = np.minimum(numbers * block + block - 1, farthest[block_run])
        run = np.repeat(block_run, high - low + 1)
        number = ragged(low, high - low + 1)
        starts = offsets[run] + place[run] - number
        prints = Prefixes(data).of(starts, starts + length)
    at = pa.array(run)
    columns = [rows.column(c).take(at) for c in ("gram", "stretch", "n", "doc_id", "digest")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(number), pa.array(prints.view(np.int64)), pa.array(first[run] + place[run] - number)],
                                      ["gram", "stretch", "n", "doc_id", "digest", "number", "print", "start"])


def parts_of_runs(rows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, start, end) of the repeated strings of runs that occur once; rows are different runs with their bytes."""
    def passed(blocks: bool):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    yield _digits(batch.slice(at, 4096), length, blocks)
        return find

    schema = "gram bigint, stretch bigint, n bigint, doc_id bigint, digest bigint, number bigint, print bigint, start bigint"
    blocks = in_groups(rows.mapInArrow(passed(True), schema), ["gram", "number", "print"], scratch, "blocks")
    wanted = blocks.groupBy("gram", "stretch").agg(F.collect_list("number").alias("wanted"))
    strings = rows.join(wanted, ["gram", "stretch"]).mapInArrow(passed(False), schema)
    # each run is here once, so a group of two is two places
    repeated = in_groups(strings, ["gram", "number", "print"], scratch, "strings").where("n = 1")
    return repeated.select("doc_id", "digest", "start", (F.col("start") + length).alias("end"))


def without_spans(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of rows (doc_id, text, starts, ends)."""
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                offsets, data = raw(texts)
                out = {"n_bytes": np.diff(offsets), "n_removed": [], "n_spans": [], "kept_sha256": []}
                for row in range(part.num_rows):
                    own = data[offsets[row]:offsets[row + 1]]
                    starts, ends = part.column("starts")[row].values, part.column("ends")[row].values
                    if starts is None or not len(starts):
                        out["n_removed"].append(0)
                        out["n_spans"].append(0)
                        out["kept_sha256"].append(hashlib.sha256(own).hexdigest())
                        continue
                    covered = np.zeros(len(own) + 1, np.int64)
                    np.add.at(covered, starts.to_numpy(), 1)
                    np.subtract.at(covered, ends.to_numpy(), 1)
                    gone = np.cumsum(covered)[:-1] > 0
                    out["n_removed"].append(int(gone.sum()))
                    out["n_spans"].append(int((gone & ~np.append(False, gone[:-1])).sum()))
                    out["kept_sha256"].append(hashlib.sha256(own[~gone]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())],
                    ["doc_id", *out])

    return rows.mapInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document without its repeated passages."""
    docs = documents(df, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"))
    spans = repeated_spans(docs, length, gram or max(1, length // 4))
    spans = spans.groupBy("doc_id", "digest").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return without_spans(docs.join(spans, ["doc_id", "digest"], "left").select("doc_id", "text", "starts", "ends"))
