"""Re-ranking flow: candidates, features, a ranker and its baselines for one or two weeks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.operators import als as als_ops
from basketline.operators.candidates import candidate_rows
from basketline.operators.features import build_features
from basketline.operators.folds import Folds
from basketline.operators.guards import same_customers
from basketline.operators.itemitem import ItemItem
from basketline.operators.compare import relative_gaps
from basketline.operators.metrics import customer_scores, metrics_by_scope
from basketline.operators.popularity import K, exclusion_lists, popularity_lists, same_list_for_all
from basketline.operators.ranker import (Ranker, complete, discover_only, lists_by, personal_baseline,
                                         repurchase_popularity, route_cold)
from basketline.session import materialize
from basketline.sources import versions
from basketline.sources.sinks import append_runs

SCORE_KEYS = ("week", "model", "customer_id", "segment")


def als_personal(folds: Folds, n: int, config) -> DataFrame:
    """(week, customer_id, article_id, score, rank) from ALS for one week.

    Written out: the candidate union reads it once for the rows and once for who has any.
    """
    fitted = als_ops.fit_als(als_ops.index_interactions(folds.history), config)
    return materialize(als_ops.top_n(fitted, folds.customers, n).withColumn("week", F.lit(folds.weeks[0])))


def item_item_personal(folds: Folds, n: int, n_items: int | None = None) -> DataFrame:
    """The same shape from item-item lists; the rank stands in for a score."""
    lists = ItemItem(folds.history, n_items).recommend(folds.customers, n, settings=(False,))
    rows = lists.select("customer_id", F.posexplode("items").alias("pos", "article_id"))
    return materialize(rows.select(F.lit(folds.weeks[0]).alias("week"), "customer_id", "article_id",
                                   (-(F.col("pos") + 1)).cast("double").alias("score"), (F.col("pos") + 1).alias("rank")))


def labelled_candidates(folds: Folds, personal: DataFrame, n: int, pop_k: int = 50, recent_days: int = 28,
                        personal_tag: str = "als") -> DataFrame:
    return candidate_rows(folds.history, folds.customers, folds.truth, personal, n, pop_k, recent_days, personal_tag)


def features_of(folds: Folds, candidates: DataFrame, personal_tag: str = "als") -> DataFrame:
    return build_features(folds.history, candidates, folds.weeks[0], personal_tag)


def ranked_models(folds: Folds, features: DataFrame, ranker: Ranker | None = None, discover: bool = False,
                  k: int = K) -> DataFrame:
    """SCORE_KEYS + items of the ranker and every baseline on the same customers."""
    customers = folds.segmented_customers().select("week", "customer_id", "segment")
    rows = discover_only(features) if discover else features
    if discover:
        popular = exclusion_lists(customers, folds.history, [7], k)
    else:
        popular = same_list_for_all(customers, popularity_lists(folds.history, [7], k), k)
    popular = popular.select("week", "customer_id", "segment", "items")
    models = {"ALS": complete(personal_baseline(rows, k), customers), "pop7d": popular}
    if not discover:
        models["repurchase+pop"] = complete(repurchase_popularity(rows, k), customers)
    if ranker is not None:
        ranked = lists_by(ranker.score(rows), [F.desc("score")], k)
        models["ranker"] = complete(ranked, customers)
        models["ranker+cold"] = route_cold(ranked, popular, customers)
    out: DataFrame | None = None
    for name, lists in models.items():
        part = lists.select("week", F.lit(name).alias("model"), "customer_id", "segment", "items")
        out = part if out is None else out.unionByName(part)
    return out


def scored_models(folds: Folds, lists: DataFrame, k: int = K) -> DataFrame:
    return customer_scores(lists, folds.truth, SCORE_KEYS, k)


# What each model is compared as: a learned model meets every rule, and the personal model if it has no rule inside.
ROLES = {"ALS": "personal", "pop7d": "rule", "repurchase+pop": "rule", "ranker": "learned", "ranker+cold": "learned with a rule"}


def model_pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    """Every learned model with what its role has to beat."""
    beats = {"learned": ("personal", "rule"), "learned with a rule": ("rule",)}
    return [(a, b) for a in models for b in models if ROLES[b] in beats.get(ROLES[a], ())]


def require_covering(folds: Folds, features: DataFrame, discover: bool = False) -> None:
    """Candidates are of evaluated customers only and, unless bought ones are left out, of all of them."""
    sides = same_customers(features, folds.customers).first()
    if sides["only_a"]:
        raise ValueError(f"{sides['only_a']} customers with candidates are not evaluated")
    if sides["only_b"] and not discover:
        raise ValueError(f"{sides['only_b']} evaluated customers have no candidates")


def ranking_report(folds: Folds, features: DataFrame, ranker: Ranker, discover: bool = False,
                   replicates: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Metrics per (model, scope), and the ranker's relative gaps with their intervals per scope."""
    require_covering(folds, features, discover)
    scores = materialize(scored_models(folds, ranked_models(folds, features, ranker, discover)))
    models = ["ALS", "pop7d", "ranker", "ranker+cold"] + ([] if discover else ["repurchase+pop"])
    return metrics_by_scope(scores, ["model"]), relative_gaps(scores, model_pairs(models), ["week"], replicates)


def run_rows(metrics: DataFrame, gaps: DataFrame, label: str, settings: Mapping[str, float]) -> DataFrame:
    """One row per scope for a run log: label, time, settings, every model's metrics, every gap with its interval."""
    models = [r[0] for r in metrics.select("model").distinct().orderBy("model").collect()]  # a handful
    pairs = [tuple(r) for r in gaps.select("a_model", "b_model").distinct().orderBy("a_model", "b_model").collect()]
    wide = metrics.groupBy("scope").agg(F.max("n_customers").alias("n"), *[
        F.max(F.when(F.col("model") == m, F.col(x))).alias(f"{m} {x}") for m in models for x in ("map", "hit_rate")])
    pair = [(F.col("a_model") == a) & (F.col("b_model") == b) for a, b in pairs]
    beside = gaps.groupBy("scope").agg(*[F.max(F.when(p, F.col(x))).alias(f"{a} vs {b} {x}")
                                         for p, (a, b) in zip(pair, pairs) for x in ("rel_pct", "ci")])
    known = {"run": F.lit(label), "run_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"),
             **{k: F.lit(v) for k, v in settings.items()}}
    return wide.join(beside, "scope", "left").select(*[c.alias(k) for k, c in known.items()], *wide.columns, *[c for c in beside.columns if c != "scope"])


def log_run(root: str, rows: DataFrame) -> DataFrame:
    """Append a run to the log under `root`, as a new version; runs may have different columns. Returns the whole log."""
    spark = rows.sparkSession
    now = versions.current(spark, root)
    folder = versions.new_version(root)
    (rows if now is None else append_runs(spark.read.parquet(now), rows)).write.parquet(folder)
    versions.switch(spark, root, folder)
    return spark.read.parquet(folder)
