"""Queries over the scalar function families the jobs use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.functions.lists import array_literal
from basketline.operators import popularity
from basketline.plans.registry import final, order_folds, order_folds_sql, pools_sql, query, with_
from basketline.sources import logs


@query("f1_dates", final("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 7 AS next_week,
  CAST(o_orderdate AS DATE) - 28 AS window_start, CAST(o_orderdate AS DATE) - (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) AS age,
  strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""", i="o_orderkey age", d="day next_week window_start", s="iso"))
def f1(spark: SparkSession, sf: str) -> DataFrame:
    o = logs.table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    first = o.agg(F.min("day")).scalar()
    return o.select("o_orderkey", "day", F.date_add("day", 7).alias("next_week"), F.date_sub("day", 28).alias("window_start"),
                    F.datediff("day", first).alias("age"), F.date_format("day", "yyyy-MM-dd").alias("iso"))


@query("f2_strings", final("""SELECT p_partkey, contains(p_name, 'ring') AS has_ring, starts_with(p_type, 'E') AS starts_e,
  regexp_full_match(p_brand, 'Brand#[0-9]{2}') AS two_digits, replace(p_brand, '#', '-') AS brand, string_split(p_name, ' ')[1] AS first_word,
  p_type || '+' || p_size AS tag FROM part""", i="p_partkey", s="has_ring starts_e two_digits brand first_word tag"))
def f2(spark, sf):
    return logs.table(spark, sf, "part").select(
        "p_partkey", F.contains("p_name", F.lit("ring")).alias("has_ring"), F.startswith("p_type", F.lit("E")).alias("starts_e"),
        F.col("p_brand").rlike("^Brand#[0-9]{2}$").alias("two_digits"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"),
        F.split("p_name", " ")[0].alias("first_word"), F.concat_ws("+", "p_type", F.col("p_size").cast("string")).alias("tag"))


@query("f3_math", final("""SELECT p_partkey, p_partkey // 1000 AS code, sqrt(p_retailprice) AS root, abs(1000 - p_retailprice) AS gap,
  round(p_retailprice / 7, 2) AS rounded, isfinite(p_retailprice) AS finite, 100 * p_size / nullif(p_partkey, 0) AS ratio FROM part""",
    i="p_partkey code", f="root gap rounded ratio", s="finite"))
def f3(spark, sf):
    price = F.col("p_retailprice")
    return logs.table(spark, sf, "part").select(
        "p_partkey", F.expr("p_partkey div 1000").alias("code"), F.sqrt(price).alias("root"), F.abs(1000 - price).alias("gap"),
        F.round(price / 7, 2).alias("rounded"), (~F.isnan(price) & (F.abs(price) != float("inf"))).alias("finite"),
        F.try_divide(100 * F.col("p_size"), F.col("p_partkey")).alias("ratio"))


F4_SQL = [*order_folds_sql((0, 1, 2)), *pools_sql([7, 28]), """li AS (SELECT week, "window", list(article_id ORDER BY rank) AS items FROM pool
  WHERE rank <= 12 GROUP BY ALL)""", """bo AS (SELECT week, max(items) FILTER ("window" = '7d') AS a, max(items) FILTER ("window" = '28d') AS b FROM li GROUP BY week)"""]


@query("f4_arrays", final(with_(*F4_SQL, select="""SELECT week, len(a) AS n, len(list_distinct(a || b)) AS n_union, len(list_intersect(a, b)) AS n_both,
  len(a) - len(list_intersect(a, b)) AS n_only_a, list_contains(b, a[1]) AS first_in_b, '{' || array_to_string(a[1:3], ',') || '}' AS head FROM bo"""),
    i="n n_union n_both n_only_a", d="week", s="first_in_b head"))
def f4(spark, sf):
    lists = popularity.popularity_lists(order_folds(spark, sf, (0, 1, 2)).history, [7, 28], 12)
    short, long = (lists.filter(F.col("window") == w).select("week", F.col("items").alias(n)) for w, n in (("7d", "a"), ("28d", "b")))
    return short.join(long, "week").select(
        "week", F.size("a").alias("n"), F.size(F.array_distinct(F.concat("a", "b"))).alias("n_union"),
        F.size(F.array_intersect("a", "b")).alias("n_both"), F.size(F.array_except("a", "b")).alias("n_only_a"),
        F.array_contains("b", F.col("a")[0]).alias("first_in_b"), array_literal(F.slice("a", 1, 3)).alias("head"))


@query("f5_lookup_with_default", final("""SELECT user_id, coalesce(c_mktsegment, 'UNKNOWN') AS segment, count(*) AS n FROM events
  LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0 GROUP BY ALL""", i="user_id n", s="segment"))
def f5(spark, sf):
    """A dictionary with a default is a left join with a coalesce."""
    names = logs.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    counted = logs.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(names, "user_id", "left").withColumn("segment", F.coalesce("segment", F.lit("UNKNOWN")))


@query("f6_json", final("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"event":' || event_id || ',"type":"' || event_type || '"}' AS meta
  FROM events""", i="event_id k", s="meta"))
def f6(spark, sf):
    parsed = F.from_json("props", "k bigint")["k"]
    meta = F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("type")))
    return logs.table(spark, sf, "events").select("event_id", parsed.alias("k"), meta.alias("meta"))


@query("f7_nulls", final("""SELECT c_custkey, c_acctbal < 0 AS unknown, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0) AS filled,
  100 / nullif(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0) AS ratio FROM customer""", i="c_custkey", f="filled ratio", s="unknown"))
def f7(spark, sf):
    age = F.col("age")
    return logs.customers(spark, sf).select(
        F.col("customer_id").alias("c_custkey"), age.isNull().alias("unknown"), F.coalesce(age, F.lit(0.0)).alias("filled"),
        (100 / F.nullif(age, F.lit(0.0))).alias("ratio"))
