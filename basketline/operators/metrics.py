"""Ranking metrics: precision, recall, hit rate and MAP at k, per customer and per segment.

Lists come as one array per customer (``items``), truth as distinct (week, customer, article)
rows. The join is on (week, customer) and the list position of each bought article is read out of
the array, so no list is exploded and the per-customer aggregate reuses the join's partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.operators.segments import with_scope

KEY = ("week", "customer_id")


def hit_positions(lists: DataFrame, truth: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Per list: n_true bought articles and the sorted list positions that hit (first occurrence only)."""
    position = F.array_position(F.slice("items", 1, k), F.col("article_id"))
    scored = lists.join(truth.hint("merge"), list(KEY), "left").withColumn("_pos", position)
    return scored.groupBy(*by).agg(
        F.count("article_id").alias("n_true"),
        F.sort_array(F.collect_list(F.when(F.col("_pos") > 0, F.col("_pos")))).alias("positions"))


def customer_scores(lists: DataFrame, truth: DataFrame, by: Sequence[str], k: int = 12) -> DataFrame:
    """ap, hit, hits and n_true per list. Customers without truth keep hit = 0 and a null ap."""
    found = hit_positions(lists, truth, by, k)
    gains = F.aggregate(
        F.transform("positions", lambda p, i: (i + 1).cast("double") / p), F.lit(0.0), lambda a, x: a + x)
    return found.select(
        *by, "n_true", F.size("positions").alias("hits"),
        F.try_divide(gains, F.when(F.col("n_true") > 0, F.least("n_true", F.lit(k)))).alias("ap"),
        F.when(F.size("positions") > 0, 1.0).otherwise(0.0).alias("hit"))


def metric_columns(k: int = 12) -> list:
    """Averages over scored lists. Hit rate divides by every list, the others by lists with truth."""
    known = F.col("n_true") > 0
    return [
        F.count(F.lit(1)).alias("n_customers"),
        F.avg(F.when(known, F.col("hits") / F.lit(float(k)))).alias("precision"),
        F.avg(F.when(known, F.col("hits") / F.col("n_true"))).alias("recall"),
        F.avg("hit").alias("hit_rate"),
        F.avg("ap").alias("map"),
    ]


def metrics(scores: DataFrame, by: Sequence[str] = (), k: int = 12) -> DataFrame:
    return scores.groupBy(*by).agg(*metric_columns(k))


def metrics_by_scope(scores: DataFrame, by: Sequence[str] = (), k: int = 12) -> DataFrame:
    """The aggregate row and one row per segment, from one pass over the scores."""
    return metrics(with_scope(scores), [*by, "scope"], k)


def map_by_positions(lists: DataFrame, truth: DataFrame, by: Sequence[str], k: int = 12) -> DataFrame:
    """MAP by a second route (exploded lists and a running hit count), to cross-check the first."""
    from pyspark.sql import Window

    rows = lists.select(*by, F.posexplode(F.slice("items", 1, k)).alias("p", "article_id"))
    first = rows.groupBy(*by, "article_id").agg((F.min("p") + 1).alias("rank"))
    hits = first.join(truth, [*KEY, "article_id"], "left_semi")
    running = hits.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("rank")))
    gained = running.groupBy(*by).agg(F.sum(F.col("n") / F.col("rank")).alias("gain"))
    sizes = truth.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_true"))
    return lists.select(*by).join(sizes, list(KEY)).join(gained, list(by), "left").select(
        *by, (F.coalesce("gain", F.lit(0.0)) / F.least("n_true", F.lit(k))).alias("ap"))
