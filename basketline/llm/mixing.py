"""Mixing sources to target weights: hash-random order, distributed prefix sums, cuts at exact budgets.

Sources by code point, null last, have the weights 5, 2, 1, repeating, and share 150% of all words;
no target is above `repeat` times its source's words, what is over goes to the others by weight.
Within a source, documents lie in the order of a hash of their id. A source's budget is its target
rounded down; it takes every document as often as the budget holds the whole source (epochs), and
then documents in hash order up to the exact word.

Prefix sums need no task that sees a whole source: the first hex digits of the hash are buckets,
whose sums are added up per source, and only the rows of one bucket are summed in order.

Defined results: a null text has size 0 and takes nothing; rows that are equal in id and size lie
next to each other in any order; rows without a doc_id take no part; sources without words have the
target 0; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketline.llm.common import documents, written
from basketline.llm.text import raw, slices, word_bounds, word_counts

WEIGHTS = (5, 2, 1)
SHARE, REPEAT = 1.5, 2
BUCKET_DIGITS = 3  # 4096 buckets of each source


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size (words) and the named columns of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in columns} | {"size": pa.array(word_counts(texts), pa.int64())})

    rows = documents(docs, "source", *more)
    columns = [c for c in rows.columns if c != "text" or "text" in more]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in columns)
    return rows.mapInArrow(run, f"{schema}, size bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """source, source_size, target. One row per source passes the two ordered windows, not one per document.

    Sources reach their cap in the order of cap / weight. Once the first j are capped, the rest share
    what is left by weight; the first j for which the next source stays below its cap is the answer.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeat)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rate = ((F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
            / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    rate = per.withColumn("rate", rate).withColumn("fits", F.col("rate") * F.col("weight") <= F.col("cap"))
    final = F.min_by(F.when(F.col("fits"), F.col("rate")), F.when(F.col("fits"), F.col("cap") / F.col("weight"))).over(every)
    return rate.select("source", "source_size",
                       F.least("cap", F.coalesce(final, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """The rows of `sizes` (doc_id, source, size, ...) with source_size, target and taken."""
    targets = source_targets(sizes, weights, share, repeat)
    rows = sizes.withColumn("key", F.md5(F.col("doc_id").cast("string"))).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    before = before.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select(
        F.col("b.source").alias("_source"), F.col("bucket").alias("_bucket"), "before", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (rows.withColumn("upto", F.sum("size").over(within))
              .join(before, F.expr("source <=> _source AND bucket = _bucket")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - (F.col("before") + F.col("upto") - F.col("size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.withColumn("taken", taken.cast("bigint")).select(*sizes.columns, "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document; texts are read once."""
    return mix(written(sized(docs), "sizes"))


def mixed_corpus(docs: DataFrame) -> DataFrame:
    """The mix itself, with all columns: a row for each time that a document is taken; the one in which a source's
    budget ends has its text cut after the last word that is taken, and n_chars follows.

    Rows that are alike in all columns are taken as one, as often as all of them together. Whole rows are shuffled once."""
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    sizes = written(sized(docs.select("doc_id", "text", "source", F.xxhash64(row).alias("alike")), "alike"), "sizes")
    rest = F.col("taken") % F.col("size")
    taken = mix(sizes).where("taken > 0").groupBy(F.col("doc_id").alias("id"), "alike").agg(
        F.sum(F.floor(F.col("taken") / F.col("size"))).alias("full"), F.collect_list(F.when(rest > 0, rest)).alias("parts"))  # one part in a source
    taken = written(taken, "taken")
    keys = Window.partitionBy("id", "alike")
    rows = (docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(row).alias("alike"), row.alias("row"))
            .withColumn("k", F.row_number().over(keys.orderBy("id"))).where("k = 1").drop("k").join(taken, ["id", "alike"]))
    copies = rows.select("row", F.explode(F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.col("full").cast("int")), "parts")).alias("words"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array([t and first_words(t, n) for t, n in zip(texts.to_pylist(), words.to_pylist())], pa.string())

    part = F.col("words") > 0
    copies = copies.withColumn("short", cut(F.when(part, F.col("row.text").cast("string")), F.col("words")))
    changed = {"text": F.col("short"), "n_chars": F.char_length("short").cast("bigint")}
    return copies.select(*[(F.when(part, changed[c]).otherwise(F.col("row")[c]) if c in changed else F.col("row")[c]).alias(c) for c in columns])


def first_words(text: str, words: int) -> str:
    """The text up to the end of its `words`-th word."""
    offsets, data = raw(pa.array([text]))
    _, _, ends = word_bounds(offsets, data)
    return data[:ends[words - 1]].tobytes().decode()
