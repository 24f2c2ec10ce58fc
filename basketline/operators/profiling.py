"""Profile tables of the log and its dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.session import materialize

RANGES = 256  # into which the distinct values of a group are parted


def counts_with_zero(dimension: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Purchases per dimension row, 0 when it never occurs in the log."""
    counted = log.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))
    return dimension.select(key).join(counted, key, "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def profile_ratios(customer_counts: DataFrame, article_counts: DataFrame) -> DataFrame:
    """Cold-start and repeat shares of customers, articles with at most one purchase."""
    def share(condition: Column) -> Column:
        return 100 * F.avg(condition.cast("double"))
    c = customer_counts.agg(share(F.col("cnt") < 3).alias("cold_start_pct"), share(F.col("cnt") > 1).alias("repeat_pct"))
    a = article_counts.agg(F.count_if(F.col("cnt") <= 1).alias("articles_0_1"), share(F.col("cnt") <= 1).alias("articles_0_1_pct"))
    return c.withColumn("_one", F.lit(1)).join(a.withColumn("_one", F.lit(1)), "_one").drop("_one")


def category_counts(log: DataFrame, articles: DataFrame, column: str) -> DataFrame:
    """Purchases and share per category. Counting per article first keeps the join at catalogue size."""
    per_article = log.groupBy("article_id").agg(F.count(F.lit(1)).alias("cnt"))
    named = per_article.join(articles.select("article_id", column), "article_id", "left")
    return value_shares(named.groupBy(column).agg(F.sum("cnt").alias("n")))


def value_shares(counts: DataFrame) -> DataFrame:
    whole = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share_pct", 100.0 * F.col("n") / whole)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, nulls included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed."""
    bounds = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    placed = df.select(F.col(value).cast("double").alias("x"), F.lit(1).alias("_one")).join(
        F.broadcast(bounds.withColumn("_one", F.lit(1))), "_one")
    at = F.when(F.col("lo") == F.col("hi"), 1).otherwise(
        F.least(F.expr(f"width_bucket(x, lo, nullif(hi, lo), {bins})"), F.lit(bins)))
    return placed.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def describe_value(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles (interpolated) of one column."""
    basic = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                   F.min(value).alias("min"), F.max(value).alias("max"))
    quarters = {f"p{p}": F.lit(p) * (F.col("n") - 1) / 100 for p in (25, 50, 75)}
    ranks = {f"{name}_{end}": (side(at) + 1).cast("bigint") for name, at in quarters.items() for end, side in (("lo", F.floor), ("hi", F.ceil))}
    found = values_at_ranks(df, value, ranks)
    between = [(F.col(f"{name}_lo") + (at - F.floor(at)) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))).alias(name) for name, at in quarters.items()]
    rows = basic.withColumn("_one", F.lit(1)).join(found.select(*between, F.lit(1).alias("_one")), "_one", "left")
    return rows.select("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def cardinalities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column, one row per column.

    Each (column, value) is reduced before the final count, so no task holds a column's value set.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])
    values = df.select(F.inline(cells)).filter(F.col("v").isNotNull()).distinct()
    return values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def ranged(df: DataFrame, value: str, by: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """(by, v, c, range): each distinct value with its count, in ranges of about equally many values.

    The splitters are quantiles of a group's own values from a mergeable sketch, so that a range is a small
    share of the values wherever they lie.
    """
    keys = list(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    # written, so that all that reads ranges sees the same ones
    cuts = materialize(counted.groupBy(*keys).agg(F.percentile_approx("v", shares, 10 * ranges).alias("cuts")))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = counted.alias("a").join(cuts.alias("b"), same) if keys else counted.alias("a").crossJoin(F.broadcast(cuts).alias("b"))
    return both.select(*[f"a.{k}" for k in keys], "v", "c", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("range"))


def values_at_ranks(df: DataFrame, value: str, ranks: Mapping[str, Column], by: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """(by, n, one column per rank): the values at 1-based ranks, each a column over the group's count n.

    Ranges are counted first; only the one that holds a rank is put in order, so no task sorts more than a
    range of the distinct values.
    """
    keys = list(by)
    rows = ranged(df, value, by, ranges)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row per range
    before = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "range").agg(F.sum("c").alias("_in")).withColumn("n", F.sum("_in").over(group)).withColumn(
        "_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    wanted = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()]),
                      lambda w: (w["rank"] > F.col("_before")) & (w["rank"] <= F.col("_before") + F.col("_in")))
    held = counts.withColumn("wanted", wanted).filter(F.size("wanted") > 0)
    same = F.expr(" AND ".join(f"a.`{k}` <=> b.`{k}`" for k in [*keys, "range"]))
    inside = Window.partitionBy(*[f"a.{k}" for k in keys], "a.range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.alias("a").join(held.alias("b"), same).select(
        *[f"a.{k}" for k in keys], "v", "n", "wanted", (F.sum("c").over(inside) + F.col("_before")).alias("cum"))
    found = placed.select(*keys, "v", "n", "cum", F.explode("wanted").alias("w")).filter("cum >= w.rank")
    return found.groupBy(*keys).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("w.name") == name, F.col("v"))).alias(name) for name in ranks])


def exact_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, median): the mean of the two middle values."""
    middle = values_at_ranks(df, value, {"low": F.expr("(n + 1) div 2"), "high": F.expr("n div 2 + 1")}, by)
    return middle.select(*by, ((F.col("low") + F.col("high")) / 2).alias("median"))


def latency_summary(log: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """n, mean, nearest-rank percentiles and max per group, rounded as the report prints them."""
    # integer ceil(p * n / 100), at least 1
    ranks = {f"p{p}": F.greatest(F.expr(f"({p} * n + 99) div 100"), F.lit(1).cast("bigint")) for p in (50, 90, 95, 99)}
    found = values_at_ranks(log, value, ranks, by)
    basic = log.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    same = F.expr(" AND ".join(f"a.`{k}` <=> b.`{k}`" for k in by))
    return basic.alias("a").join(found.alias("b"), same).select(
        *[f"a.{k}" for k in by], "n", *[F.round(c, 3).alias(c) for c in ("mean", *ranks, "max")])


def upper_median(runs: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The upper of the two middle values over runs."""
    return values_at_ranks(runs, value, {value: F.expr("n div 2 + 1")}, by).drop("n")


def relative_change(curve: DataFrame, step: str, value: str) -> DataFrame:
    """Percent change against the previous step; a curve has one row per iteration."""
    before = F.lag(value).over(Window.orderBy(step))
    return curve.withColumn("rel_change_pct", F.try_divide(100 * (F.col(value) - before), before))


def loss_reading(curve: DataFrame, at: int, step: str = "iteration", value: str = "loss") -> DataFrame:
    """How much of the total decline a curve had made by a step, and what was left after it."""
    row = curve.agg(F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"),
                    F.max(F.when(F.col(step) == at, F.col(value))).alias("at"))
    return row.select(
        "first", "last", "at", F.try_divide(100 * (F.col("first") - F.col("at")), F.col("first") - F.col("last")).alias("share_pct"),
        F.try_divide(100 * (F.col("at") - F.col("last")), F.col("at")).alias("remaining_pct"))
