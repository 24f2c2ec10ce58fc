"""Point-in-time features for (customer, candidate article) rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.functions.windows import days_before_cutoff
from basketline.operators.folds import refuse_leak

# The feature columns, in order.
FEATURES = ("als_score", "als_rank", "src_als", "src_pop", "src_recent",
            "item_cnt_7d", "item_cnt_28d", "item_price_mean_28d",
            "ci_count", "ci_days_since", "cust_n_purchases", "cust_days_since_last")


def source_flags(candidates: DataFrame, personal_tag: str = "als") -> DataFrame:
    return candidates.withColumns({
        "src_als": F.col("source").contains(personal_tag).cast("tinyint"),
        "src_pop": F.col("source").contains("pop").cast("tinyint"),
        "src_recent": F.col("source").contains("recent").cast("tinyint")})


def personal_only(candidates: DataFrame) -> DataFrame:
    """Rank and score count only where the personal model produced the pair."""
    own = F.col("src_als") == 1
    return candidates.withColumns({
        "als_rank": F.when(own, F.col("source_rank")), "als_score": F.when(own, F.col("als_score"))})


def item_features(history: DataFrame, cutoff: dt.date) -> DataFrame:
    """7- and 28-day counts and the 28-day mean price, in one pass over the last 28 days."""
    day = F.lit(cutoff)
    return history.filter(days_before_cutoff(day, 28)).groupBy("article_id").agg(
        F.count_if(days_before_cutoff(day, 7)).alias("item_cnt_7d"),
        F.count(F.lit(1)).alias("item_cnt_28d"), F.avg("price").alias("item_price_mean_28d"))


def customer_item_features(history: DataFrame, customers: DataFrame, cutoff: dt.date) -> DataFrame:
    """Times bought and days since, per (customer, article) of the target customers."""
    own = history.join(customers.select("customer_id").distinct(), "customer_id", "left_semi")
    pairs = own.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("ci_count"), F.max("t_dat").alias("ci_last"))
    return pairs.withColumn("ci_days_since", F.datediff(F.lit(cutoff), "ci_last"))


def customer_features(pairs: DataFrame) -> DataFrame:
    """Purchases and days since the last one, rolled up from the pair features instead of the log."""
    return pairs.groupBy("customer_id").agg(
        F.sum("ci_count").alias("cust_n_purchases"), F.min("ci_days_since").alias("cust_days_since_last"))


def attach(candidates: DataFrame, items: DataFrame, pairs: DataFrame, people: DataFrame) -> DataFrame:
    out = (candidates.join(pairs.drop("ci_last"), ["customer_id", "article_id"], "left")
           .join(people, "customer_id", "left").join(items, "article_id", "left"))
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in
                            ("item_cnt_7d", "item_cnt_28d", "ci_count", "cust_n_purchases")})


def build_features(history: DataFrame, candidates: DataFrame, cutoff: dt.date, personal_tag: str = "als",
                   guard: bool = True) -> DataFrame:
    """Candidates plus the feature columns; refuses a history that reaches the cutoff."""
    if guard:
        refuse_leak(history, cutoff)
    tagged = personal_only(source_flags(candidates, personal_tag))
    pairs = customer_item_features(history, candidates, cutoff)
    return attach(tagged, item_features(history, cutoff), pairs, customer_features(pairs))


def describe(features: DataFrame, columns=FEATURES) -> DataFrame:
    """count, mean, min and max of each feature, one row per feature."""
    cells = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("count"), F.avg(c).alias("mean"),
                      F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns]
    return features.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def means_by_label(features: DataFrame, columns=FEATURES) -> DataFrame:
    return features.groupBy("label").agg(*[F.avg(c).alias(c) for c in columns])
