"""Purchase logs and dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketline.session import path_exists

TRANSACTIONS = T.StructType([
    T.StructField("t_dat", T.DateType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("article_id", T.IntegerType()),
    T.StructField("price", T.FloatType()),
    T.StructField("sales_channel_id", T.ByteType()),
])
CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("FN", T.DoubleType()),
    T.StructField("Active", T.DoubleType()),
    T.StructField("club_member_status", T.StringType()),
    T.StructField("fashion_news_frequency", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("postal_code", T.StringType()),
])


def load_transactions(spark: SparkSession, data_dir: str, schema: T.StructType = TRANSACTIONS) -> DataFrame:
    """The parquet copy if there is one, else the CSV with fixed types; t_dat is always a date."""
    parquet = f"{data_dir}/transactions_train.parquet"
    if path_exists(spark, parquet):
        log = spark.read.parquet(parquet)
    else:
        log = spark.read.schema(schema).csv(f"{data_dir}/transactions_train.csv", header=True)
    return log.withColumn("t_dat", F.to_date("t_dat"))


def load_dimension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A dimension CSV under a given schema; inference would cost a second pass."""
    return spark.read.schema(schema).csv(path, header=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide catalogue, sparse purchases: one row per order line."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_linestatus")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("article_id"),
        F.to_date("o_orderdate").alias("t_dat"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("sales_channel_id"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense repeat purchases over a small catalogue: the purchase events."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return events.select(
        F.col("user_id").alias("customer_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("article_id"),
        F.to_date("ts").alias("t_dat"),
        F.col("value").alias("price"),
        F.lit(1).alias("sales_channel_id"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer table in the model's columns; unset flags, unknown ages and statuses are null."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_acctbal") > 5000, 1.0).alias("FN"),
        F.when(F.col("c_acctbal") > 7500, 1.0).alias("Active"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("club_member_status"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("None"))
        .when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("fashion_news_frequency"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("age"),
        F.col("c_nationkey").cast("string").alias("postal_code"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article table in the model's columns."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("article_id"),
        F.expr("p_partkey div 1000").alias("product_code"),
        F.col("p_name").alias("prod_name"),
        F.col("p_brand").alias("product_group_name"),
        F.col("p_type").alias("department_name"),
        F.col("p_size").alias("section_no"),
        F.concat_ws(" ", "p_name", "p_type").alias("detail_desc"))


def hashed_id(column: str) -> Column:
    """A 64-hex customer id from a numeric key."""
    return F.sha2(F.col(column).cast("string"), 256)
