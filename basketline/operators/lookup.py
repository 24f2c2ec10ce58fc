"""Batch lookup: resolve requests against exported lists, else the latest fallback list.

No actions, and every join keeps the request side, so the same plan serves a streaming request
table joined to the static tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.operators.guards import DEFAULT_MODE, request_status

FALLBACK_SOURCE = "fallback_popularity_7d"
MODEL_SOURCE = "als"


def latest_fallback(fallbacks: DataFrame, source: str = FALLBACK_SOURCE) -> DataFrame:
    """The newest row of a source, or no row."""
    rows = fallbacks.filter(F.col("source") == source)
    newest = F.max_by(F.struct(*fallbacks.columns), F.col("as_of")).alias("r")
    return rows.groupBy("source").agg(newest).select("r.*")


def resolve(requests: DataFrame, recommendations: DataFrame, fallbacks: DataFrame,
            source: str = FALLBACK_SOURCE, model_source: str = MODEL_SOURCE) -> DataFrame:
    """requests (customer_id, mode, ...) to responses with status, source, model_version and items.

    400 malformed, 200 with the personal list or the fallback list, 503 when there is neither.
    """
    asked = (requests.withColumn("valid", request_status(F.col("customer_id"), F.col("mode")) == 200)
             .withColumn("mode", F.coalesce("mode", F.lit(DEFAULT_MODE))))
    personal = recommendations.select(
        "customer_id", "mode", F.col("items").alias("_items"), F.col("model_version").alias("_version"))
    newest = latest_fallback(fallbacks, source).select(
        F.lit(True).alias("valid"), F.col("items").alias("_fallback"), F.col("model_version").alias("_fallback_version"))
    found = (asked.join(personal, ["customer_id", "mode"], "left")
             .join(F.broadcast(newest), "valid", "left"))  # the fallback side has at most one row
    hit = F.col("valid") & F.col("_items").isNotNull()
    miss = F.col("valid") & F.col("_items").isNull() & F.col("_fallback").isNotNull()
    return found.select(
        *[c for c in requests.columns if c != "mode"], "mode",
        F.when(~F.col("valid"), 400).when(hit | miss, 200).otherwise(503).alias("status"),
        F.when(hit, model_source).when(miss, source).alias("source"),
        F.when(hit, F.col("_version")).when(miss, F.col("_fallback_version")).alias("model_version"),
        F.when(hit, F.col("_items")).when(miss, F.col("_fallback")).alias("items"))
