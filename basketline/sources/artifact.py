"""The saved model: factor tables with their own ids, and one metadata row."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.operators.als import FittedALS
from basketline.operators.guards import require_clean, side_by_side, structure_checks


@dataclass(frozen=True)
class Artifact:
    user_factors: DataFrame  # customer_id, features
    item_factors: DataFrame  # article_id, features
    meta: dict


def save_artifact(fitted: FittedALS, path: str, fallback: list[int], history_end, fallback_days: int = 7,
                  recorded_map: Mapping[str, float] | None = None) -> None:
    """Factors, fallback list, config, the last history day and, if known, MAP by mode; readable without the fitted model."""
    users, items = fitted.user_factors, fitted.item_factors
    users.write.mode("overwrite").parquet(f"{path}/user_factors")
    items.write.mode("overwrite").parquet(f"{path}/item_factors")
    spark = users.sparkSession
    meta = {"config": dict(fitted.config), "fallback_days": fallback_days, "fallback_top12": list(fallback),
            "history_end": str(history_end), "recorded_map": dict(recorded_map or {}),
            "n_customers": spark.read.parquet(f"{path}/user_factors").count(),
            "n_items": spark.read.parquet(f"{path}/item_factors").count()}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_artifact(spark: SparkSession, path: str) -> Artifact:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Artifact(spark.read.parquet(f"{path}/user_factors"), spark.read.parquet(f"{path}/item_factors"), meta)


def artifact_findings(artifact: Artifact) -> DataFrame:
    """One row that counts what is wrong with a saved model; all zero when it can be served."""
    sides = []
    for name, table, key, kept in (("customer", artifact.user_factors, "customer_id", "n_customers"),
                                   ("article", artifact.item_factors, "article_id", "n_items")):
        found = structure_checks(table, key)
        sides.append(found.select(
            F.abs(F.col("n_rows") - artifact.meta[kept]).alias(f"{name}_rows_off"), F.col("repeated_ids").alias(f"{name}_repeats"),
            F.col("non_finite").alias(f"{name}_non_finite"), F.col("min_size").alias(f"{name}_least"), F.col("max_size").alias(f"{name}_most")))
    sizes = [F.col(f"{n}_{end}") for n in ("customer", "article") for end in ("least", "most")]
    both = side_by_side(*sides).withColumn("size_spread", F.greatest(*sizes) - F.least(*sizes))
    return both.drop(*[f"{n}_{end}" for n in ("customer", "article") for end in ("least", "most")])


def require_servable(artifact: Artifact) -> None:
    findings = artifact_findings(artifact)
    require_clean(findings, *findings.columns)
