"""Cleaning of the log and the two dimension tables, and the global customer id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketline.functions.ids import dense_index
from basketline.operators.profiling import exact_median

# The columns the cleaning rules name.
KEY_FIELDS = ("customer_id", "article_id", "t_dat")
FLAGS = ("FN", "Active")
TEXT_COLUMNS = ("detail_desc", "prod_name", "product_code")


def duplicate_rows(log: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one. They are purchases of several units, so they stay."""
    groups = log.groupBy(*(columns or log.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates"))


def drop_missing_keys(log: DataFrame, keys: Sequence[str] = KEY_FIELDS) -> DataFrame:
    return log.dropna(subset=list(keys))


def keep_positive_price(log: DataFrame) -> DataFrame:
    return log.filter(F.col("price") > 0)


def clean_transactions(log: DataFrame) -> DataFrame:
    return keep_positive_price(drop_missing_keys(log))


def cleaning_breakdown(log: DataFrame, keys: Sequence[str] = KEY_FIELDS) -> DataFrame:
    """Rows and percent dropped by each rule, in rule order, from one pass."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    priced = F.coalesce(F.col("price") > 0, F.lit(False))
    counts = log.agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(missing).alias("n_missing_key"),
        F.count_if(~missing & ~priced).alias("n_bad_price"))
    share = {c: F.try_divide(100.0 * F.col(c), F.col("n_before")) for c in ("n_missing_key", "n_bad_price")}
    return counts.select(
        "*", (F.col("n_missing_key") + F.col("n_bad_price")).alias("n_dropped"),
        share["n_missing_key"].alias("pct_missing_key"), share["n_bad_price"].alias("pct_bad_price"))


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first in an explicit order, since a table has no row order of its own."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(F.col(key).alias("_key")).agg(first).select("r.*")


def fill_flags(customers: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """An unset flag is false, not unknown."""
    return customers.withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("tinyint") for c in flags if c in customers.columns})


def fill_categories(customers: DataFrame) -> DataFrame:
    filled = {}
    if "club_member_status" in customers.columns:
        filled["club_member_status"] = F.coalesce("club_member_status", F.lit("UNKNOWN"))
    if "fashion_news_frequency" in customers.columns:
        news = F.coalesce("fashion_news_frequency", F.lit("NONE"))
        filled["fashion_news_frequency"] = F.when(news == "None", "NONE").otherwise(news)
    return customers.withColumns(filled)


def impute_age(customers: DataFrame) -> DataFrame:
    """Median age for unknown ages, with a flag that tells imputed from known."""
    if "age" not in customers.columns:
        return customers
    median = exact_median(customers, "age").scalar()
    return (customers.withColumn("age_missing", F.isnull("age").cast("tinyint"))
            .withColumn("age", F.coalesce("age", median)))


def clean_customers(customers: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One row per customer; without an order, all other columns decide which one stays."""
    first = first_per_key(customers, "customer_id", order or [c for c in customers.columns if c != "customer_id"])
    return impute_age(fill_categories(fill_flags(first)))


def clean_articles(articles: DataFrame, order: Sequence[str] | None = None,
                   text: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """One row per article; without an order, all other columns decide which one stays."""
    order = order or [c for c in articles.columns if c != "article_id"]
    return first_per_key(articles, "article_id", order).drop(*text)


def customer_id_lookup(customers: DataFrame) -> DataFrame:
    """customer_id -> customer_idx, built once from the customer table over sorted ids."""
    return dense_index(customers.select("customer_id").distinct(), ["customer_id"], "customer_idx")


def apply_customer_idx(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Attach customer_idx. A row without one fails the job instead of vanishing downstream."""
    known = df.join(lookup, "customer_id", "left")
    message = F.concat(F.lit("customer id not in the lookup: "), F.coalesce(F.col("customer_id").cast("string"), F.lit("null")))
    idx = F.when(F.col("customer_idx").isNull(), F.raise_error(message).cast("bigint")).otherwise(F.col("customer_idx"))
    return known.withColumn("customer_idx", idx.cast("int"))


def unmapped_customers(df: DataFrame, lookup: DataFrame, examples: int = 5) -> DataFrame:
    """How many rows have no id, and the first few such customers."""
    missing = df.join(lookup, "customer_id", "left_anti").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("customer_id")
    shown = missing.select("customer_id").orderBy("customer_id").limit(examples).withColumn("at", F.row_number().over(w))
    listed = shown.agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("at", "customer_id"))), lambda x: x["customer_id"].cast("string")), ",").alias("examples"))
    total = missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_customers"))
    return total.withColumn("examples", listed.scalar())


def product_codes(articles: DataFrame) -> DataFrame:
    """Articles per product code (the id without its last three digits)."""
    return articles.groupBy(F.expr("article_id div 1000").alias("product_code")).agg(
        F.count(F.lit(1)).alias("n_articles"))
