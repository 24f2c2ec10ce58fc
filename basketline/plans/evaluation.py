"""Evaluation flows: policy grid, model comparison, weekly backtest, fallback diagnostic, sweep."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.functions.windows import window_label
from basketline.operators import als as als_ops
from basketline.operators import compare
from basketline.operators.folds import Folds, build_folds, check_folds
from basketline.operators.itemitem import ItemItem, with_fallback
from basketline.operators.guards import value_gap
from basketline.operators.metrics import customer_scores, map_by_positions, metrics_by_scope
from basketline.operators.popularity import (K, article_counts, count_order, popularity_lists, recency_lists,
                                             same_list_for_all)
from basketline.operators.segments import SEGMENTS
from basketline.functions.lists import to_lists, top_k
from basketline.session import materialize
from basketline.sources.score_store import ScoreStore
from basketline.sources.sinks import sample_rows

ITEM_ITEM, ALS_MODEL = "item-item CF", "ALS"
FALLBACK_DAYS, RECENCY_DAYS = 7, 14
WINDOWS = (7, 14, 28, None)
PAIRS = ((ALS_MODEL, ITEM_ITEM), (ALS_MODEL, "recency 14d"), (ITEM_ITEM, "recency 14d"))
LIST_KEYS = ("week", "setting", "model", "customer_id", "segment")


def setting_label(exclusion: Column) -> Column:
    return F.when(exclusion, "exclusion=True").otherwise("exclusion=False")


def recency_models(folds: Folds, windows: Sequence[int | None] = (RECENCY_DAYS,), k: int = K) -> DataFrame:
    """LIST_KEYS + items for the trailing-window lists, both settings, all weeks at once."""
    lists = recency_lists(folds.segmented_customers(), folds.history, windows, k)
    return lists.select("week", setting_label(F.col("exclusion")).alias("setting"),
                        F.concat(F.lit("recency "), "window").alias("model"), "customer_id", "segment", "items")


def _both_settings(customers: DataFrame) -> DataFrame:
    return customers.withColumn("exclusion", F.explode(F.array(F.lit(True), F.lit(False))))


def _finished(personal: DataFrame, folds: Folds, fallback: DataFrame, model: str) -> DataFrame:
    """Personal lists (customer_id, exclusion, items) completed with the fallback list."""
    customers = _both_settings(folds.segmented_customers())
    full = with_fallback(personal, customers, fallback.select("week", "items"), ["customer_id", "exclusion"])
    return full.select("week", setting_label(F.col("exclusion")).alias("setting"), F.lit(model).alias("model"),
                       "customer_id", "segment", "items")


def fallback_list(folds: Folds, days: int | None = FALLBACK_DAYS, k: int = K) -> DataFrame:
    return popularity_lists(folds.history, [days], k)


def item_item_model(folds: Folds, n_items: int | None = None, k: int = K, fallback_days: int | None = FALLBACK_DAYS) -> DataFrame:
    """One week: item-item lists, with the popularity list for customers outside the matrix."""
    personal = ItemItem(folds.history, n_items).recommend(folds.customers, k)
    return _finished(personal, folds, fallback_list(folds, fallback_days, k), ITEM_ITEM)


def als_model(folds: Folds, config: Mapping[str, float], k: int = K, name: str = ALS_MODEL, seed: int = als_ops.SEED,
              data: als_ops.Interactions | None = None) -> DataFrame:
    """One week: one fit, both settings from the same score block; `data` is the week's matrix if it is there already."""
    fitted = als_ops.fit_als(data or als_ops.index_interactions(folds.history), config, seed)
    lists = als_ops.recommend(fitted, folds.customers, folds.history, k)
    personal = lists.select("customer_id", (F.col("mode") == "discover").alias("exclusion"), "items")
    return _finished(personal, folds, fallback_list(folds, k=k), name)


def score_lists(lists: DataFrame, truth: DataFrame, k: int = K) -> DataFrame:
    return customer_scores(lists, truth, LIST_KEYS, k)


def verified_scores(lists: DataFrame, truth: DataFrame, k: int = K, customers: int = 3000) -> DataFrame:
    """Scores of lists, refused unless a second route gives the same average precision for a sample of customers."""
    lists = materialize(lists)
    scores = materialize(score_lists(lists, truth, k))
    some = sample_rows(lists.select("customer_id").distinct(), customers, "customer_id")
    again = map_by_positions(lists.join(some, "customer_id", "left_semi"), truth, LIST_KEYS, k)
    gap = value_gap(scores.join(some, "customer_id", "left_semi"), again, LIST_KEYS, "ap").first()["max_gap"]
    if gap is not None and gap > 1e-9:
        raise ValueError(f"average precisions of two routes differ by up to {gap}")
    return scores


def three_models(folds: Folds, config: Mapping[str, float] = als_ops.FROZEN, n_items: int | None = None, k: int = K) -> DataFrame:
    """Per-customer scores of ALS, item-item and the 14-day list under both settings, one week."""
    lists = (als_model(folds, config, k).unionByName(item_item_model(folds, n_items, k))
             .unionByName(recency_models(folds, k=k)))
    return verified_scores(lists, folds.truth, k)


def policy_grid(folds: Folds, windows: Sequence[int | None] = WINDOWS, k: int = K) -> DataFrame:
    """Metrics per (week, window, exclusion, segment) for the cold-start policy."""
    lists = recency_lists(folds.segmented_customers(), folds.history, windows, k)
    scores = customer_scores(lists, folds.truth, ["week", "window", "exclusion", "customer_id", "segment"], k)
    rows = metrics_by_scope(scores, ["week", "window", "exclusion"], k)
    return rows.filter(F.col("scope").isin(*SEGMENTS)).withColumnRenamed("scope", "segment")


def week_overlap(folds: Folds, lists: DataFrame, k: int = K) -> DataFrame:
    """Per (week, window): articles shared with the week's own top k, and percent of purchases the list covers."""
    sold = article_counts(folds.target, ["week"])
    best = to_lists(top_k(sold, ["week"], count_order(), k), ["week"], out="best")
    listed = lists.select("week", "window", F.slice("items", 1, k).alias("items"))
    overlap = listed.join(F.broadcast(best), "week").select(
        "week", "window", F.size(F.array_intersect("items", "best")).alias("overlap"))
    rows = listed.select("week", "window", F.explode("items").alias("article_id"))
    covered = sold.join(F.broadcast(rows), ["week", "article_id"]).groupBy("week", "window").agg(F.sum("cnt").alias("covered"))
    totals = sold.groupBy("week").agg(F.sum("cnt").alias("total"))
    return (overlap.join(covered, ["week", "window"], "left").join(totals, "week")
            .select("week", "window", "overlap", (100.0 * F.coalesce("covered", F.lit(0)) / F.col("total")).alias("coverage_pct")))


def diagnose_fallback(folds: Folds, windows: Sequence[int | None] = WINDOWS, replicates: int = 2000,
                      seed: int = 42, k: int = K) -> DataFrame:
    """One row per (week, window): the same list for everyone, scored on the cold segment and on all."""
    lists = popularity_lists(folds.history, windows, k)
    given = same_list_for_all(folds.segmented_customers(), lists, k).withColumnRenamed("window", "model")
    scores = customer_scores(given, folds.truth, ["week", "model", "customer_id", "segment"], k)
    cold = F.col("segment") == SEGMENTS[0]
    points = scores.groupBy("week", "model").agg(
        F.count_if(cold).alias("n_seg0"), F.avg(F.when(cold, F.col("ap"))).alias("seg0_map"),
        F.avg(F.when(cold, F.col("hit"))).alias("seg0_hit"), F.avg("ap").alias("all_map"), F.avg("hit").alias("all_hit"))
    base = window_label(FALLBACK_DAYS)
    pairs = [(window_label(d), base) for d in windows if window_label(d) != base]
    gaps = compare.compare_models(scores, pairs, ["week"], replicates, seed, metrics=("ap",), scopes=(SEGMENTS[0],))
    star = F.when(F.col("sig") != 0, "*").otherwise("")
    text = F.when(F.col("verdict") == "identical", "identical").otherwise(
        F.when(F.col("rel_diff_pct").isNotNull(), F.concat(F.format_string("%+.1f%%", "rel_diff_pct"), star)))
    gaps = gaps.select("week", F.col("a_model").alias("model"), text.alias("seg0_vs_7d"))
    return (points.join(gaps, ["week", "model"], "left")
            .withColumn("seg0_vs_7d", F.when(F.col("model") == base, "").otherwise(F.col("seg0_vs_7d")))
            .withColumnRenamed("model", "window").join(week_overlap(folds, lists, k), ["week", "window"]))


def weekly_comparison(scores: DataFrame, pairs=PAIRS, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Relative gap and significance per (week, setting, metric, scope, pair)."""
    rows = compare.compare_models(scores, pairs, ["week", "setting"], replicates, seed, scopes=compare.SUMMARY_SCOPES)
    return rows.withColumn("pair", F.concat("a_model", F.lit(" vs "), "b_model"))


def backtest(log: DataFrame, weeks: Sequence[dt.date], store: ScoreStore, config: Mapping[str, float] = als_ops.FROZEN,
             n_items: int | None = None, target_days: int = 7, history_days: int | None = None, at_once: int = 2,
             reserved_from: dt.date | None = None) -> DataFrame:
    """Score every fold not stored yet and return the per-customer scores of all of them; no fold may reach reserved days."""
    def score(week: dt.date, _config: str) -> DataFrame:
        fold = build_folds(log, [week], target_days, history_days)
        check_folds(fold, reserved_from)
        return three_models(fold, config, n_items)

    store.fill(weeks, ["frozen"], score, at_once)
    return store.read(weeks)


def sweep(log: DataFrame, weeks: Sequence[dt.date], store: ScoreStore, grid: Mapping[str, Mapping[str, float]],
          target_days: int = 7, history_days: int | None = None, at_once: int = 2) -> DataFrame:
    """ALS configs by week under both settings, stored per (week, config) so that a sweep resumes.

    All configs of a week share one matrix; independent fits run at the same time.
    """
    made, lock = {}, threading.Lock()

    def matrix(week: dt.date) -> tuple[Folds, als_ops.Interactions]:
        with lock:
            if week not in made:
                fold = build_folds(log, [week], target_days, history_days)
                check_folds(fold)
                made[week] = fold, als_ops.index_interactions(fold.history)
            return made[week]

    def score(week: dt.date, config: str) -> DataFrame:
        fold, data = matrix(week)
        return verified_scores(als_model(fold, grid[config], name=config, data=data), fold.truth)

    store.fill(weeks, list(grid), score, at_once)
    return store.read(weeks)
