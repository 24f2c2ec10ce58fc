"""Cold-start bands by history purchase count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The band labels used in every result table.
SEGMENTS = ("0 purchases", "1-2 purchases", "3+ purchases")
AGGREGATE = "aggregate"
SCOPES = (AGGREGATE, *SEGMENTS)


def segment_band(count: Column) -> Column:
    return F.when(count == 0, SEGMENTS[0]).when(count <= 2, SEGMENTS[1]).otherwise(SEGMENTS[2])


def purchase_counts(history: DataFrame, by: Sequence[str] = ("week", "customer_id")) -> DataFrame:
    return history.groupBy(*by).agg(F.count(F.lit(1)).alias("n_purchases"))


def segment_customers(history: DataFrame, customers: DataFrame,
                      by: Sequence[str] = ("week", "customer_id")) -> DataFrame:
    """customers plus n_purchases (0 when unseen) and the band label."""
    own = history.join(customers.select(*by), list(by), "left_semi")
    counted = customers.join(purchase_counts(own, by), list(by), "left")
    n = F.coalesce(F.col("n_purchases"), F.lit(0))
    return counted.withColumn("n_purchases", n).withColumn("segment", segment_band(F.col("n_purchases")))


def with_scope(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Every row once for the aggregate and once for its own band."""
    return df.withColumn("scope", F.explode(F.array(F.lit(AGGREGATE), F.col(segment))))
