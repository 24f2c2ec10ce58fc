"""Candidate sets for re-ranking, their labels and their recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.functions.windows import days_of_history, history_ends
from basketline.operators.popularity import popularity_lists
from basketline.operators.segments import with_scope

FALLBACK_DAYS = 7


def recent_purchases(history: DataFrame, customers: DataFrame, days: int) -> DataFrame:
    """Distinct articles each target customer bought in the last ``days`` history days (max - (days - 1) on)."""
    recent = days_of_history(history, history_ends(history), days).select("week", "customer_id", "article_id")
    return recent.join(customers.select("week", "customer_id"), ["week", "customer_id"], "left_semi").distinct()


def recent_coverage(customers: DataFrame, recent: DataFrame) -> DataFrame:
    """Share of customers with any recent purchase and the mean number of recent articles."""
    sizes = recent.groupBy("week", "customer_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return (customers.join(sizes, ["week", "customer_id"], "left").groupBy("week")
            .agg((100 * F.avg((n > 0).cast("double"))).alias("pct_any"), F.avg(n).alias("mean_items")))


def _pop_rows(customers: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    short = lists.select("week", F.slice("items", 1, k).alias("items"))
    return customers.join(F.broadcast(short), "week").select(
        "week", "customer_id", F.posexplode("items").alias("pos", "article_id"))


def candidate_rows(history: DataFrame, customers: DataFrame, truth: DataFrame, personal: DataFrame, n: int,
                   pop_k: int = 12, recent_days: int = 0, personal_tag: str = "als") -> DataFrame:
    """One labelled row per (week, customer, article).

    personal holds (week, customer_id, article_id, score, rank). Customers without any get the n
    best sellers of the last 7 days instead. Everyone also gets the pop_k best sellers and their own
    recent purchases. All sources and the truth meet in a single aggregation per pair; the source
    tag lists them in that order and source_rank is the personal (or cold list) rank.
    """
    people = customers.select("week", "customer_id")
    lists = popularity_lists(history, [FALLBACK_DAYS], max(n, pop_k))
    none = F.lit(None).cast("double")
    rows = personal.filter(F.col("rank") <= n).select(
        "week", "customer_id", "article_id", F.lit(0).alias("kind"), F.lit(personal_tag).alias("tag"),
        F.col("score").cast("double").alias("score"), F.col("rank").cast("double").alias("rank"))
    cold = people.join(personal.select("week", "customer_id").distinct(), ["week", "customer_id"], "left_anti")
    parts = [
        _pop_rows(cold, lists, n).select(
            "week", "customer_id", "article_id", F.lit(0).alias("kind"), F.lit("pop").alias("tag"),
            none.alias("score"), (F.col("pos") + 1.0).alias("rank")),
        _pop_rows(people, lists, pop_k).select(
            "week", "customer_id", "article_id", F.lit(1).alias("kind"), F.lit(f"pop{pop_k}").alias("tag"),
            none.alias("score"), none.alias("rank"))]
    if recent_days > 0:
        parts.append(recent_purchases(history, people, recent_days).select(
            "week", "customer_id", "article_id", F.lit(2).alias("kind"), F.lit("recent").alias("tag"),
            none.alias("score"), none.alias("rank")))
    parts.append(truth.join(people, ["week", "customer_id"], "left_semi").select(
        "week", "customer_id", "article_id", F.lit(3).alias("kind"), F.lit(None).cast("string").alias("tag"),
        none.alias("score"), none.alias("rank")))
    for part in parts:
        rows = rows.unionByName(part)
    tags = [F.max(F.when(F.col("kind") == kind, F.col("tag"))) for kind in range(3)]
    merged = rows.groupBy("week", "customer_id", "article_id").agg(
        F.concat_ws("+", *tags).alias("source"), F.max("score").alias("als_score"),
        F.max("rank").alias("source_rank"), F.max((F.col("kind") == 3).cast("int")).alias("label"))
    return merged.filter(F.col("source") != "")


def candidate_recall(candidates: DataFrame, customers: DataFrame, truth: DataFrame, ns: Sequence[int],
                     pop_k: int = 12, config: str = "als+pop12") -> DataFrame:
    """Pair recall, customer coverage and mean size per scope, for the personal list alone and the union.

    The rows hold the largest n; smaller n keep the ranks up to n. One aggregation per customer
    measures every n.
    """
    cuts = {}
    for n in ns:
        own = F.col("source_rank") <= n
        # tags after the first: pop<k> or recent put a pair into the union at any n
        extra = F.col("source").contains(f"pop{pop_k}") | F.col("source").contains("recent")
        for name, inside in (("als_only", own), (config, own | extra)):
            inside = F.coalesce(inside, F.lit(False))
            cuts[f"{name}|{n}"] = (name, n, F.count_if(inside), F.count_if(inside & (F.col("label") == 1)))
    key = ["week", "customer_id"]
    sizes = candidates.groupBy(*key).agg(*[
        F.struct(size.alias("size"), hit.alias("hits")).alias(c) for c, (_, _, size, hit) in cuts.items()])
    n_true = truth.groupBy(*key).agg(F.count(F.lit(1)).alias("n_true"))
    people = customers.select(*key, "segment").join(n_true, key).join(sizes, key, "left")
    cells = F.array(*[
        F.struct(F.lit(name).alias("candidates"), F.lit(n).alias("n"),
                 F.coalesce(F.col(f"`{c}`.size"), F.lit(0)).alias("size"),
                 F.coalesce(F.col(f"`{c}`.hits"), F.lit(0)).alias("hits"))
        for c, (name, n, _, _) in cuts.items()])
    rows = with_scope(people.select("week", "segment", "n_true", F.inline(cells)))
    return rows.groupBy("week", "candidates", "n", "scope").agg(
        F.count(F.lit(1)).alias("n_customers"), (F.sum("hits") / F.sum("n_true")).alias("pair_recall"),
        F.avg((F.col("hits") > 0).cast("double")).alias("customer_coverage"), F.avg("size").alias("mean_candidates"))
