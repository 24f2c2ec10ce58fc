"""Serving flows: export of a saved model, load of an export, and refresh of the fallback list."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketline.functions.lists import to_lists
from basketline.operators.als import recommend_from
from basketline.operators.guards import DEFAULT_MODE, MODES, require_refreshable
from basketline.operators.lookup import FALLBACK_SOURCE, latest_fallback
from basketline.operators.metrics import customer_scores, metrics
from basketline.operators.popularity import K, recent_top
from basketline.sources import sinks
from basketline.sources.artifact import Artifact, load_artifact, require_servable


def lists_by_products(artifact: Artifact, some: DataFrame, history: DataFrame, k: int = K) -> DataFrame:
    """Both modes of a few customers by plain dot products and a ranking: the second route to their lists."""
    people = artifact.user_factors.join(some, "customer_id", "left_semi").select("customer_id", F.col("features").alias("u"))
    products = F.zip_with("u", "features", lambda x, y: x.cast("double") * y.cast("double"))
    scored = people.crossJoin(artifact.item_factors).select(
        "customer_id", "article_id", F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), 9).alias("score"))
    owned = history.select("customer_id", "article_id").distinct().withColumn("owned", F.lit(True))
    scored = scored.join(owned, ["customer_id", "article_id"], "left").withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    kept = scored.filter((F.col("mode") == DEFAULT_MODE) | F.col("owned").isNull())
    best = Window.partitionBy("customer_id", "mode").orderBy(F.desc("score"), F.asc("article_id"))
    return to_lists(kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), ["customer_id", "mode"])


def model_version(spark: SparkSession, meta: Mapping) -> str:
    """The version of a saved model, from its own metadata."""
    row = {**meta["config"], "history_end": str(meta["history_end"])}
    frame = spark.createDataFrame([tuple(row.values())], list(row))
    return frame.select(sinks.version_column(frame)).first()[0]


def reproduced_map(artifact: Artifact, history: DataFrame, truth: DataFrame, k: int = K, tolerance: float = 1e-6) -> dict[str, float]:
    """MAP by mode of a week scored from the saved tables alone; refused if it is not what was recorded with the model.

    truth: distinct (week, customer_id, article_id). Customers without factors get the saved fallback list.
    """
    people = truth.select("week", "customer_id").distinct()
    lists = recommend_from(artifact.user_factors, artifact.item_factors, people, history, k).select("customer_id", "mode", "items")
    modes = F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode")
    fallback = F.array(*[F.lit(a).cast("bigint") for a in artifact.meta["fallback_top12"]])
    full = people.select("week", "customer_id", modes).join(lists, ["customer_id", "mode"], "left").withColumn("items", F.coalesce("items", fallback))
    scores = customer_scores(full, truth, ["week", "customer_id", "mode"], k)
    found = {r["mode"]: r["map"] for r in metrics(scores, ["mode"], k).select("mode", "map").collect()}
    for mode, value in artifact.meta["recorded_map"].items():
        if abs(found.get(mode, float("inf")) - value) > tolerance:
            raise ValueError(f"{mode} lists score {found.get(mode)}, recorded is {value}")
    return found


def export_artifact(spark: SparkSession, artifact_path: str, history: DataFrame, root: str, overwrite: bool = False,
                    limit: int | None = None, k: int = K) -> dict:
    """Both modes of every customer of a saved model, through all gates; one product serves both modes."""
    artifact = load_artifact(spark, artifact_path)
    require_servable(artifact)
    known = history.join(artifact.item_factors.select("article_id"), "article_id", "left_semi")
    lists = recommend_from(artifact.user_factors, artifact.item_factors, artifact.user_factors.select("customer_id"), known, k)
    fallback = spark.createDataFrame(
        [(FALLBACK_SOURCE, dt.date.fromisoformat(artifact.meta["history_end"]), artifact.meta["fallback_days"], artifact.meta["fallback_top12"],
          model_version(spark, artifact.meta))], sinks.FALLBACK_TABLE)
    return sinks.export_lists(
        lists.select("customer_id", "mode", "items"), known.select("customer_id", "article_id").distinct(), root,
        model_version(spark, artifact.meta), fallback, artifact.meta, overwrite, limit, k, artifact.user_factors, artifact.item_factors,
        history.agg(F.max("t_dat")).first()[0], lambda some: lists_by_products(artifact, some, known, k))


@dataclass(frozen=True)
class Refresh:
    """What a refresh found and did."""

    as_of: dt.date
    window_start: dt.date
    first_sale: dt.date
    last_sale: dt.date
    served_as_of: dt.date
    served_items: list[int]
    items: list[int]
    kept: int
    written: bool


def refresh_fallback(spark: SparkSession, tables: str, log: DataFrame, as_of: dt.date, days: int = 7, k: int = K,
                     source: str = FALLBACK_SOURCE, dry_run: bool = False) -> Refresh:
    """Count, check, write and read back a newer fallback list; any refusal leaves the served table as it is.

    Refused are a date that the log or the served list speaks against, a list that is not k distinct
    articles, and a table without a row to carry the model version on from.
    """
    table = sinks.served_fallbacks(spark, tables)
    served = latest_fallback(table.read(), source).first()
    if served is None:
        raise LookupError(f"no {source} list to carry the model version on from; load an export first")
    low, high = log.agg(F.min("t_dat"), F.max("t_dat")).first()
    require_refreshable(spark.createDataFrame([(as_of, low, high, served["as_of"])], "as_of date, first_sale date, last_sale date, served date"), days)
    items = [r["article_id"] for r in recent_top(log, F.lit(as_of), days, k).orderBy("rank").collect()]  # k rows
    if len(set(items)) != k:
        raise ValueError(f"the {days} days up to {as_of} sold {len(set(items))} articles, {k} are needed")
    found = Refresh(as_of, as_of - dt.timedelta(days=days - 1), low, high, served["as_of"], list(served["items"]), items,
                    len(set(items) & set(served["items"])), not dry_run)
    if dry_run:
        return found
    rows = table.read()
    new = sinks.upsert_fallback(rows, spark.createDataFrame([(items,)], "items array<bigint>"), F.lit(as_of), source, days)
    table.upsert(new.filter((F.col("source") == source) & (F.col("as_of") == F.lit(as_of))))
    back = latest_fallback(table.read(), source).first()
    if (back["as_of"], list(back["items"])) != (as_of, items):
        raise RuntimeError(f"the newest list is that of {back['as_of']}, not what was written")
    return found
