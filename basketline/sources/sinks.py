"""Writers: prepared tables, result tables, exports with checks, and keyed updates.

Plain parquet and CSV folders have no transactions. Updates therefore write a complete new folder
and the caller switches to it; nothing overwrites a folder that the same plan reads.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketline.functions.lists import array_literal, parse_array_literal
from basketline.operators.guards import HEX_ID, MODES, export_checks, id_checks, list_checks, list_parity, require_clean, side_by_side
from basketline.sources import versions
from basketline.sources.keyed import KeyedTable

# The names of the gates in a manifest, in the order in which they run.
GATES = ("ids", "fallback", "history_end", "row_count_and_distinct", "no_bought_in_discover", "parity")
PARITY_SAMPLE, PARITY_LEAST = 300, 0.995

RECOMMENDATIONS = "customer_id string, mode string, items string, model_version string"
FALLBACKS = "source string, as_of date, window_days int, items string, model_version string"
FALLBACK_TABLE = "source string, as_of date, window_days int, items array<bigint>, model_version string"


def laid_out_by_day(log: DataFrame) -> DataFrame:
    """Date-ordered files, so that a date filter skips files and row groups.

    The customer is a second range key, so that one heavy day still spreads over several tasks.
    """
    return log.repartitionByRange("t_dat", "customer_id").sortWithinPartitions("t_dat", "customer_id")


def write_prepared(out_dir: str, transactions: DataFrame, customers: DataFrame, articles: DataFrame,
                   lookup: DataFrame) -> None:
    """The prepared tables; the log is partitioned by split, so loading one split reads one folder."""
    laid_out_by_day(transactions).write.mode("overwrite").partitionBy("split").parquet(f"{out_dir}/transactions")
    customers.write.mode("overwrite").parquet(f"{out_dir}/customers_clean")
    articles.write.mode("overwrite").parquet(f"{out_dir}/articles_clean")
    lookup.write.mode("overwrite").parquet(f"{out_dir}/customer_id_lookup")


def load_split(spark: SparkSession, out_dir: str, *splits: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One or more splits, pruned to the columns asked for."""
    log = spark.read.parquet(f"{out_dir}/transactions").filter(F.col("split").isin(*splits))
    return log.select(*columns) if columns else log.drop("split")


def write_result(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str],
                 renames: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Old rows whose key is not rewritten, plus the new rows; legacy key values are renamed first."""
    for column, names in (renames or {}).items():
        for before, after in names.items():
            old = old.withColumn(column, F.when(F.col(column) == before, after).otherwise(F.col(column)))
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def append_runs(log: DataFrame, run: DataFrame) -> DataFrame:
    """Append with a union of the columns; a column either side lacks is null there."""
    return log.unionByName(run, allowMissingColumns=True)


def exported_rows(lists: DataFrame, version: str) -> DataFrame:
    return lists.select("customer_id", "mode", array_literal("items").alias("items"), F.lit(version).alias("model_version"))


def limited_customers(lists: DataFrame, limit: int) -> DataFrame:
    """The first customers by id, for a trial export."""
    first = lists.select("customer_id").distinct().orderBy("customer_id").limit(limit)
    return lists.join(first, "customer_id", "left_semi")


def export_lists(lists: DataFrame, owned: DataFrame, root: str, version: str, fallback: DataFrame, meta: Mapping, overwrite: bool = False,
                 limit: int | None = None, k: int = 12, customers: DataFrame | None = None, articles: DataFrame | None = None,
                 history_end=None, recompute: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Write both modes and the fallback list as a new version of `root`, put it through the gates, then show it.

    The gates run in order and any of them refuses the whole export: the ids of `customers` and
    `articles`, the fallback list against `articles`, `history_end` against the metadata, then what was
    written, read back: rows, sizes and repeats, bought articles in discover lists, and lists of
    sampled customers against `recompute` (the second route to the same lists). A gate whose input
    is not given does not run and is not named in the manifest. `customers` are all that the model knows:
    the export is partial if it leaves any of them out. Refuses an existing export unless told to overwrite.
    """
    spark, begun = lists.sparkSession, time.monotonic()
    if not overwrite and versions.current(spark, root) is not None:
        raise FileExistsError(f"{root} already holds an export")
    passed: list[str] = []
    everyone = (lists if customers is None else customers).select("customer_id").distinct()
    if customers is not None and articles is not None:
        require_clean(id_checks(customers, articles), "bad_customer_ids", "repeated_customer_ids", "bad_article_ids", "repeated_article_ids")
        passed.append(GATES[0])
    if articles is not None:
        bad = list_checks(fallback.select("source", "items"), ["source"], articles, k).agg(F.count_if(~F.col("ok")).alias("bad_fallback"))
        require_clean(bad, "bad_fallback")
        passed.append(GATES[1])
    if history_end is not None:
        if str(history_end) != str(meta["history_end"]):
            raise ValueError(f"the history ends on {history_end}, the model's on {meta['history_end']}")
        passed.append(GATES[2])
    chosen = limited_customers(lists, limit) if limit is not None else lists
    folder = versions.new_version(root)
    exported_rows(chosen, version).write.option("header", True).csv(f"{folder}/recommendations")
    fallback.withColumn("items", array_literal("items")).write.option("header", True).csv(f"{folder}/fallback")
    written = load_recommendations(spark, f"{folder}/recommendations")
    checks = export_checks(written, owned, k)
    row = checks.first()
    checks = spark.createDataFrame([row], checks.schema)  # one row, not to be computed for every gate
    require_clean(checks, "wrong_size", "with_repeats", "without_both_modes")
    n_asked = everyone.count() if limit is None else min(limit, everyone.count())
    if row["n_rows"] != len(MODES) * n_asked:
        raise ValueError(f"{row['n_rows']} rows for {n_asked} customers")
    passed.append(GATES[3])
    require_clean(checks, "owned_in_discover")
    passed.append(GATES[4])
    if recompute is not None:
        some = sample_rows(written.select("customer_id").distinct(), PARITY_SAMPLE, "customer_id")
        same = list_parity(written.join(some, "customer_id", "left_semi"), recompute(some), ["customer_id", "mode"]).first()["share_identical"]
        if (same or 0.0) < PARITY_LEAST:
            raise ValueError(f"only {100 * (same or 0.0):.1f}% of the sampled lists equal their recomputation")
        passed.append(GATES[5])
    first = fallback.first()
    summary = {
        "created_utc": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), "model_version": version,
        "history_end": str(meta["history_end"]), "k": k, "modes": list(MODES), "customers_exported": row["n_customers"],
        "customers_in_artifact": everyone.count(), "partial_export": row["n_customers"] < everyone.count(), "rows": row["n_rows"],
        "fallback_source": first["source"], "fallback_items": list(first["items"]), "export_seconds": round(time.monotonic() - begun, 1),
        "files": {name: versions.folder_bytes(spark, f"{folder}/{name}") for name in ("recommendations", "fallback")}, "checks_passed": passed}
    spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    versions.switch(spark, root, folder)
    return summary


def export_folder(spark: SparkSession, root: str) -> str:
    """The export that readers see."""
    return versions.require_current(spark, root)


def load_manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{export_folder(spark, root)}/manifest").first()[0])


def broken_constraints(recommendations: DataFrame, fallbacks: DataFrame, k: int = 12) -> DataFrame:
    """One row: how often loaded rows break each rule of the two tables; all zero when they may be served."""
    def wrong(condition: Column) -> Column:
        return F.count_if(~F.coalesce(condition, F.lit(False)))

    rows = recommendations.agg(
        wrong(F.col("customer_id").rlike(HEX_ID)).alias("customer_id"), wrong(F.col("mode").isin(*MODES)).alias("mode"),
        wrong(F.size("items") == k).alias("items"), wrong(F.col("model_version").isNotNull()).alias("model_version"))
    twice = recommendations.groupBy("customer_id", "mode").count().agg(F.count_if(F.col("count") > 1).alias("repeated_keys"))
    lists = fallbacks.agg(
        wrong(F.col("source").isNotNull() & F.col("as_of").isNotNull()).alias("fallback_key"), wrong(F.col("window_days") > 0).alias("fallback_window"),
        wrong(F.size("items") == k).alias("fallback_items"), wrong(F.col("model_version").isNotNull()).alias("fallback_version"))
    also = fallbacks.groupBy("source", "as_of").count().agg(F.count_if(F.col("count") > 1).alias("repeated_fallback_keys"))
    return side_by_side(rows, twice, lists, also)


def load_export(spark: SparkSession, root: str, tables: str, partial: bool = False, k: int = 12) -> DataFrame:
    """Replace both served tables by the current export, or neither; returns rows per mode and version.

    A partial export is refused unless asked for, as are rows that break a constraint.
    """
    folder = export_folder(spark, root)
    if load_manifest(spark, root)["partial_export"] and not partial:
        raise ValueError(f"{root} is a partial export")
    rows, lists = load_recommendations(spark, f"{folder}/recommendations"), load_fallbacks(spark, f"{folder}/fallback")
    broken = broken_constraints(rows, lists, k)
    require_clean(broken, *broken.columns)
    target = versions.new_version(tables)
    rows.write.parquet(f"{target}/recommendations")
    fallback_lists(spark, target).upsert(lists)
    versions.switch(spark, tables, target)
    return load_counts(served_recommendations(spark, tables))


def served_recommendations(spark: SparkSession, tables: str) -> DataFrame:
    return spark.read.parquet(f"{versions.require_current(spark, tables)}/recommendations")


def fallback_lists(spark: SparkSession, version: str) -> KeyedTable:
    return KeyedTable(spark, f"{version}/fallback_lists", ["source", "as_of"], FALLBACK_TABLE, 8)


def served_fallbacks(spark: SparkSession, tables: str) -> KeyedTable:
    """The fallback lists beside the recommendations that readers see."""
    return fallback_lists(spark, versions.require_current(spark, tables))


def load_recommendations(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(RECOMMENDATIONS).csv(path, header=True)
    return rows.withColumn("items", parse_array_literal("items"))


def load_fallbacks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(FALLBACKS).csv(path, header=True)
    return rows.withColumn("items", parse_array_literal("items"))


def load_counts(recommendations: DataFrame) -> DataFrame:
    return recommendations.groupBy("mode", "model_version").agg(F.count(F.lit(1)).alias("customers"))


def fallback_row(items: DataFrame, as_of: Column, version: Column | str, source: str, window_days: int = 7) -> DataFrame:
    """A one-row fallback table out of a one-row ``items`` frame."""
    v = F.lit(version) if isinstance(version, str) else version
    return items.select(F.lit(source).alias("source"), as_of.alias("as_of"), F.lit(window_days).alias("window_days"),
                        "items", v.alias("model_version"))


def upsert_fallback(table: DataFrame, items: DataFrame, as_of: Column, source: str, window_days: int = 7) -> DataFrame:
    """Insert or replace the (source, as_of) row; the version is carried over from the newest row.

    Without an existing row of the source nothing is inserted, so repeating it changes nothing.
    """
    newest = table.filter(F.col("source") == source).groupBy("source").agg(
        F.max_by("model_version", "as_of").alias("model_version"))
    new = newest.join(items.withColumn("source", F.lit(source)), "source").select(
        "source", as_of.alias("as_of"), F.lit(window_days).alias("window_days"), "items", "model_version")
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("source", "as_of").orderBy(F.desc("_new"))
    merged = both.withColumn("_at", F.row_number().over(w))
    # a replaced row keeps the version it was written with
    kept = F.coalesce(F.min_by("model_version", "_new").over(Window.partitionBy("source", "as_of")), F.col("model_version"))
    return merged.withColumn("model_version", kept).filter("_at = 1").drop("_new", "_at")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows at random but repeatable: the smallest digests of (seed, key)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


# The letter of each part of a version, in its order.
VERSION_PARTS = {"f": "factors", "r": "regularization", "a": "alpha", "i": "iterations", "h": "history_end"}


def version_column(meta: DataFrame) -> Column:
    """als, then each part's letter and value: a column over rows of metadata. Whole numbers have no decimals."""
    kinds = dict(meta.dtypes)

    def text(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.regexp_replace(value, r"\.0+$", "") if kinds[name] in ("double", "float") else value

    return F.concat_ws("-", F.lit("als"), *[F.concat(F.lit(letter), text(name)) for letter, name in VERSION_PARTS.items()])
