"""Learning to rank on feature rows: boosted trees on LambdaRank gradients, and the rule baselines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.functions.lists import to_lists, top_k
from basketline.operators.boosting import Tree, binned, boost, quantile_cuts
from basketline.operators.features import FEATURES

K = 12
GROUP = ("week", "customer_id")
DAY_LIMIT = 28


def discover_only(features: DataFrame) -> DataFrame:
    """Candidates the customer never bought."""
    return features.filter(F.col("ci_count") == 0)


def with_positive(features: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Groups without a purchase among the candidates teach a ranker nothing."""
    positive = features.filter(F.col("label") == 1).select(*group).distinct()
    return features.join(positive, list(group), "left_semi")


def grouped_for_training(features: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Rows of a customer together and in a fixed order."""
    return features.repartition(*group).sortWithinPartitions(*group, "article_id")


def group_sizes(features: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    return features.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_positive"))


@dataclass
class Ranker:
    """A sum of regression trees over binned features, each scaled by the learning rate."""

    trees: list[Tree]
    shares: list[float]
    cuts: list[np.ndarray]
    learning_rate: float = 0.05
    columns: Sequence[str] = FEATURES

    def score(self, features: DataFrame, out: str = "score") -> DataFrame:
        trees, cuts, rate, n = self.trees, self.cuts, self.learning_rate, len(self.columns)

        @F.pandas_udf("double")
        def predict(rows: pd.DataFrame) -> pd.Series:
            bins = binned([rows.iloc[:, i].to_numpy(np.float64, na_value=np.nan) for i in range(n)], cuts)
            total = np.zeros(len(rows))
            for tree in trees:
                total += rate * tree.values(bins)
            return pd.Series(total)

        return features.withColumn(out, predict(F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns])))

    def importances(self) -> list[tuple[str, float]]:
        """Each feature's share of the gain over all trees."""
        return list(zip(self.columns, self.shares))


def train_ranker(features: DataFrame, rounds: int = 300, learning_rate: float = 0.05, leaves: int = 63,
                 min_rows: int = 50, truncation: int = 30, checkpoint_every: int = 10,
                 columns: Sequence[str] = FEATURES) -> Ranker:
    """Boosting on LambdaRank gradients; ties of the score go to the lower article id."""
    rows = with_positive(features).select(*GROUP, "article_id", "label", *columns)
    cuts = quantile_cuts(rows, columns)
    trees, shares = boost(rows, columns, cuts, GROUP, "article_id", rounds, learning_rate, leaves, min_rows, truncation, checkpoint_every)
    return Ranker(trees, shares, cuts, learning_rate, columns)


def lists_by(rows: DataFrame, order: Sequence[Column], k: int = K, group: Sequence[str] = GROUP) -> DataFrame:
    """Top-k per customer; ties keep the candidate order (source rank, then article)."""
    ties = [F.asc_nulls_last("source_rank"), F.asc("article_id")]
    return to_lists(top_k(rows, group, [*order, *ties], k), group)


def repurchase_popularity(features: DataFrame, k: int = K) -> DataFrame:
    """Own purchases of the last 28 days first, newest first; the rest by 7-day count."""
    recent = F.coalesce(F.col("ci_days_since") <= DAY_LIMIT, F.lit(False))
    days, count = F.when(recent, F.col("ci_days_since")), F.when(~recent, F.col("item_cnt_7d"))
    return lists_by(features, [F.desc(recent), F.asc_nulls_last(days), F.desc_nulls_last(count)], k)


def cold_rows(features: DataFrame) -> DataFrame:
    """Rows of customers the personal model does not know."""
    return features.filter((F.col("src_als") == 0) & F.col("source").startswith("pop") & F.col("source_rank").isNotNull())


def personal_baseline(features: DataFrame, k: int = K) -> DataFrame:
    """The personal model's own lists, rebuilt from candidate rows; cold customers get the popularity rows."""
    own = lists_by(features.filter(F.col("src_als") == 1), [F.asc("als_rank")], k)
    cold = lists_by(cold_rows(features), [F.asc("source_rank")], k).join(
        own.select(*GROUP), list(GROUP), "left_anti")
    return own.unionByName(cold)


def complete(lists: DataFrame, customers: DataFrame) -> DataFrame:
    """Every target customer once; without candidates the list is empty (and scores 0)."""
    empty = F.array().cast("array<bigint>")
    return customers.join(lists, list(GROUP), "left").withColumn("items", F.coalesce("items", empty))


def route_cold(ranked: DataFrame, popular: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers without history get the popularity list, everyone else the ranked one."""
    base = complete(ranked, customers).join(
        popular.select(*GROUP, F.col("items").alias("_popular")), list(GROUP), "left")
    cold = F.col("segment") == "0 purchases"
    return base.withColumn("items", F.when(cold, F.col("_popular")).otherwise(F.col("items"))).drop("_popular")
