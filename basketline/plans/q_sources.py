"""Queries over sources, sinks and keyed updates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.functions.lists import array_literal, parse_array_literal, to_rows
from basketline.operators import als as als_ops
from basketline.operators import metrics as met
from basketline.operators import popularity, prepare
from basketline.operators.folds import temporal_split
from basketline.operators.itemitem import ItemItem
from basketline.operators.lookup import FALLBACK_SOURCE, latest_fallback
from basketline.plans import serving
from basketline.plans.evaluation import recency_models
from basketline.plans.q_prepare import EXPORT, SPLIT, candidates_sql, event_candidates
from basketline.plans.registry import (clean_order_log, CLEAN, EVENT_LOG, ORDER_LOG, SCOPED, event_folds, event_folds_sql, final, item_item_sql,
                                       order_folds, order_folds_sql, pools_sql, query, recency_sql, scores_sql, with_)
from basketline.session import materialize, scratch_path
from basketline.sources import artifact, logs, sinks, versions
from basketline.sources.score_store import ScoreStore

SMALL_ALS = {"factors": 8, "regularization": 0.1, "alpha": 15.0, "iterations": 5}


@query("s1_load_transactions", final(with_(ORDER_LOG, select="""SELECT t_dat, sales_channel_id, count(*) AS n,
  count(DISTINCT customer_id) AS n_customers, avg(CAST(CAST(price AS FLOAT) AS DOUBLE)) AS price FROM lg GROUP BY ALL"""),
    i="sales_channel_id n n_customers", f="price", d="t_dat"))
def s1(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a CSV without a parquet copy, loaded with fixed types."""
    folder = scratch_path(spark, "raw")
    columns = [f.name for f in logs.TRANSACTIONS]
    logs.order_log(spark, sf).select(*columns).write.option("header", True).csv(f"{folder}/transactions_train.csv")
    return logs.load_transactions(spark, folder).groupBy("t_dat", "sales_channel_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("customer_id").alias("n_customers"),
        F.avg(F.col("price").cast("double")).alias("price"))


@query("s2_load_dimension", final("""SELECT nullif(c_mktsegment, 'HOUSEHOLD') AS club_member_status, count(*) AS n,
  count(*) FILTER (c_acctbal > 5000) AS n_fn, count(*) FILTER (c_acctbal < 0) AS n_no_age FROM customer GROUP BY ALL""",
    i="n n_fn n_no_age", s="club_member_status"))
def s2(spark, sf):
    path = f"{scratch_path(spark, 'raw')}/customers.csv"
    logs.customers(spark, sf).write.option("header", True).csv(path)
    return logs.load_dimension(spark, path, logs.CUSTOMERS).groupBy("club_member_status").agg(
        F.count(F.lit(1)).alias("n"), F.count("FN").alias("n_fn"), F.count_if(F.col("age").isNull()).alias("n_no_age"))


@query("s3_limited_scan", final("SELECT least(count(*), 1000000) AS n_rows FROM lineitem", i="n_rows"))
def s3(spark, sf):
    """The first million rows, whatever they are."""
    return logs.table(spark, sf, "lineitem").select("l_partkey").limit(1_000_000).agg(F.count(F.lit(1)).alias("n_rows"))


def prepared_folder(spark: SparkSession, sf: str) -> str:
    folder = scratch_path(spark, "prepared")
    people = prepare.clean_customers(logs.customers(spark, sf))
    lookup = prepare.customer_id_lookup(people)
    log = prepare.apply_customer_idx(prepare.clean_transactions(logs.order_log(spark, sf)), lookup)
    sinks.write_prepared(folder, temporal_split(log), prepare.apply_customer_idx(people, lookup),
                         prepare.clean_articles(logs.articles(spark, sf)), lookup)
    return folder


@query("s4_load_split", final(with_(ORDER_LOG, CLEAN, SPLIT, select="""SELECT t_dat, count(*) AS n, count(DISTINCT article_id) AS n_articles
  FROM sp WHERE split IN ('val', 'test') GROUP BY t_dat"""), i="n n_articles", d="t_dat"))
def s4(spark, sf):
    held_out = sinks.load_split(spark, prepared_folder(spark, sf), "val", "test", columns=["t_dat", "article_id"])
    return held_out.groupBy("t_dat").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("article_id").alias("n_articles"))


@query("s5_write_prepared", final(with_(ORDER_LOG, CLEAN, SPLIT, select="""SELECT 'transactions_' || split AS name, count(*) AS n
  FROM sp GROUP BY split UNION ALL SELECT 'customers_clean', count(*) FROM customer UNION ALL SELECT 'articles_clean', count(*) FROM part
  UNION ALL SELECT 'customer_id_lookup', count(*) FROM customer"""), i="n", s="name"))
def s5(spark, sf):
    folder = prepared_folder(spark, sf)
    log = spark.read.parquet(f"{folder}/transactions").groupBy(F.concat(F.lit("transactions_"), "split").alias("name")).agg(
        F.count(F.lit(1)).alias("n"))
    for name in ("customers_clean", "articles_clean", "customer_id_lookup"):
        log = log.unionByName(spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)))
    return log


@query("s6_write_result_csv", final(with_(*order_folds_sql((0, 1, 2)), *pools_sql([7, 28]),
    select="""SELECT week, "window", rank, article_id, cnt FROM pool WHERE rank <= 12"""), i="rank article_id cnt", d="week", s="window"))
def s6(spark, sf):
    f = order_folds(spark, sf, (0, 1, 2))
    counts = popularity.window_counts(f.history, [7, 28])
    best = popularity.top_k(counts, ["week", "window"], popularity.count_order(), 12)
    path = scratch_path(spark, "result")
    sinks.write_result(best, path)
    return spark.read.schema("week date, window string, article_id bigint, cnt bigint, rank int").csv(path, header=True)


OLD_RUN = """SELECT week, CASE WHEN "window" = '28d' THEN '4w' ELSE "window" END AS config, sum(cnt) AS n, count(*) AS n_articles
  FROM wc GROUP BY ALL"""


def run_rows(spark, sf, offsets, windows):
    f = order_folds(spark, sf, offsets)
    return popularity.window_counts(f.history, windows).groupBy("week", F.col("window").alias("config")).agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("n_articles"))


@query("s7_replace_keys", final(with_(*order_folds_sql((0, 1, 2)), *pools_sql([7, 28]),
    f"old AS (SELECT * FROM ({OLD_RUN}))", """new AS (SELECT week, "window" AS config, 2 * sum(cnt) AS n, count(*) AS n_articles FROM wc
  WHERE "window" = '28d' AND week = (SELECT max(week) FROM fw) GROUP BY ALL)""",
    "ren AS (SELECT week, CASE WHEN config = '4w' THEN '28d' ELSE config END AS config, n, n_articles FROM old)",
    select="SELECT * FROM ren ANTI JOIN new USING (week, config) UNION ALL SELECT * FROM new"), i="n n_articles", d="week", s="config"))
def s7(spark, sf):
    """A result table under a legacy config name, with one (week, config) run again."""
    rows = run_rows(spark, sf, (0, 1, 2), [7, 28])
    latest = rows.agg(F.max("week")).scalar()
    new = rows.filter((F.col("config") == "28d") & (F.col("week") == latest)).withColumn("n", 2 * F.col("n"))
    old = rows.withColumn("config", F.when(F.col("config") == "28d", "4w").otherwise(F.col("config")))
    return sinks.replace_keys(old, new, ["week", "config"], {"config": {"4w": "28d"}})


@query("s8_append_runs", final(with_(*order_folds_sql((0, 1)), *pools_sql([7, 28]),
    select="""SELECT week, "window" AS config, sum(cnt) AS n, count(*) AS n_articles, NULL AS top_count FROM wc WHERE "window" = '7d' GROUP BY ALL
  UNION ALL SELECT week, "window", sum(cnt), NULL, max(cnt) FROM wc WHERE "window" = '28d' GROUP BY ALL"""),
    i="n", f="n_articles top_count", d="week", s="config"))
def s8(spark, sf):
    first = run_rows(spark, sf, (0, 1), [7])
    f = order_folds(spark, sf, (0, 1))
    later = popularity.window_counts(f.history, [28]).groupBy("week", F.col("window").alias("config")).agg(
        F.sum("cnt").alias("n"), F.max("cnt").alias("top_count"))
    rows = sinks.append_runs(later, first)  # either run lacks a column of the other
    return rows.withColumns({c: F.col(c).cast("double") for c in ("n_articles", "top_count")})


@query("s9_save_candidates", final(with_(*candidates_sql(), select="""SELECT week, source, count(*) AS n, sum(label) AS n_positive,
  coalesce(sum(source_rank), 0) AS ranks FROM cd GROUP BY week, source"""), i="n n_positive ranks", d="week", s="source"))
def s9(spark, sf):
    _, rows = event_candidates(spark, sf)
    path = scratch_path(spark, "candidates")
    rows.write.partitionBy("week").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("week").cast("date").alias("week"), "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_positive"), F.coalesce(F.sum("source_rank"), F.lit(0)).cast("bigint").alias("ranks"))


META = {"factors": 150, "regularization": 0.1, "alpha": 15.0, "iterations": 40}
EXPORT_ROWS = """er AS (SELECT sha256(CAST(customer_id AS VARCHAR)) AS customer_id, mode,
  '{' || string_agg(article_id, ',' ORDER BY rank) || '}' AS items,
  'als-f150-r0.1-a15-i40-h' || (SELECT max(t_dat) FROM h) AS model_version FROM ex GROUP BY ALL)"""
FALLBACK_ROW = """fr AS (SELECT 'fallback_popularity_7d' AS source, (SELECT max(t_dat) FROM h) AS as_of, 7 AS window_days,
  '{' || string_agg(article_id, ',' ORDER BY rank) || '}' AS items, 'als-f150-r0.1-a15-i40-h' || (SELECT max(t_dat) FROM h) AS model_version
  FROM pool WHERE rank <= 12)"""
# lists of every customer with a history, not only of those who buy in the target week
EXPORT_SQL = [*event_folds_sql(), *pools_sql([7]), *[c.replace("JOIN cust USING", "JOIN h USING") for c in item_item_sql()], EXPORT, EXPORT_ROWS, FALLBACK_ROW]


def version_at(spark: SparkSession, end) -> str:
    """The version of the frozen model with this history end."""
    meta = spark.createDataFrame([(*META.values(), str(end))], "factors int, regularization double, alpha double, iterations int, history_end string")
    return meta.select(sinks.version_column(meta)).first()[0]


def exported(spark: SparkSession, sf: str) -> tuple[str, dict]:
    """Both modes of the item-item lists of every customer with a history and the fallback list, through the gates."""
    f = event_folds(spark, sf)
    end = f.history.agg(F.max("t_dat")).first()[0]
    version = version_at(spark, end)
    hashed = logs.hashed_id("customer_id").alias("customer_id")
    mode = F.when(F.col("exclusion"), "discover").otherwise("repurchase").alias("mode")
    everyone = f.history.select("customer_id").distinct()
    lists = materialize(ItemItem(f.history).recommend(everyone).select(hashed, mode, "items"))
    owned = f.history.select(hashed, "article_id").distinct()
    fallback = sinks.fallback_row(popularity.popularity_lists(f.history, [7], 12).select("items"), F.lit(end), version, FALLBACK_SOURCE)
    root = scratch_path(spark, "export")
    summary = sinks.export_lists(lists, owned, root, version, fallback, {"history_end": end}, customers=everyone.select(hashed),
                                 articles=f.history.select("article_id").distinct(), history_end=end)
    return root, summary


@query("s10_export_lists", final(with_(*EXPORT_SQL, select="SELECT * FROM er"), s="customer_id mode items model_version"))
def s10(spark, sf):
    root, _ = exported(spark, sf)
    return spark.read.schema(sinks.RECOMMENDATIONS).csv(f"{sinks.export_folder(spark, root)}/recommendations", header=True)


def saved_model(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """An ALS model of the event history, saved under hashed customer ids, and that history."""
    f = event_folds(spark, sf)
    history = materialize(f.history.withColumn("customer_id", logs.hashed_id("customer_id")))
    fitted = als_ops.fit_als(als_ops.index_interactions(history), SMALL_ALS)
    path = scratch_path(spark, "artifact")
    fallback = popularity.popularity_lists(f.history, [7], 12).first()["items"]
    artifact.save_artifact(fitted, path, fallback, f.history.agg(F.max("t_dat")).first()[0])
    return path, history


@query("s10_export_saved_model", final(with_(*event_folds_sql(), *pools_sql([7]), """kn AS (SELECT customer_id, count(DISTINCT article_id) AS n FROM h GROUP BY 1)""",
    f"""mo AS (SELECT unnest(['repurchase', 'discover']) AS mode)""", select=f"""SELECT mode, count(*) AS customers, 0 AS owned,
  'als-f{SMALL_ALS['factors']}-r{SMALL_ALS['regularization']}-a{SMALL_ALS['alpha']:g}-i{SMALL_ALS['iterations']}-h' || (SELECT max(t_dat) FROM h) AS model_version,
  'ids,fallback,history_end,row_count_and_distinct,no_bought_in_discover,parity' AS gates FROM kn, mo GROUP BY mode"""),
    i="customers owned", s="mode model_version gates"))
def s10_model(spark, sf):
    """A saved model's lists of all its customers, exported through all six gates and loaded: rows by mode and version,
    listed articles that the customer owns in discover lists, and the gates that ran."""
    path, history = saved_model(spark, sf)
    root, tables = scratch_path(spark, "export"), scratch_path(spark, "served")
    summary = serving.export_artifact(spark, path, history, root)
    counts = sinks.load_export(spark, root, tables)
    shown = sinks.served_recommendations(spark, tables).filter("mode = 'discover'").select("customer_id", F.explode("items").alias("article_id"))
    owned = shown.join(history, ["customer_id", "article_id"], "left_semi").agg(F.count(F.lit(1)).alias("owned"))
    return counts.crossJoin(F.broadcast(owned)).withColumn("gates", F.lit(",".join(summary["checks_passed"])))


@query("s11_export_fallback", final(with_(*EXPORT_SQL, select="SELECT * FROM fr"), i="window_days", d="as_of", s="source items model_version"))
def s11(spark, sf):
    f = event_folds(spark, sf)
    end = f.history.agg(F.max("t_dat")).first()[0]
    row = sinks.fallback_row(popularity.popularity_lists(f.history, [7], 12).select("items"), F.lit(end),
                             version_at(spark, end), FALLBACK_SOURCE)
    path = scratch_path(spark, "fallback")
    sinks.write_result(row.withColumn("items", array_literal("items")), path)
    return spark.read.schema(sinks.FALLBACKS).csv(path, header=True)


@query("s12_export_manifest", final(with_(*EXPORT_SQL, select="""SELECT any_value(model_version) AS model_version,
  (SELECT max(t_dat) FROM h) AS history_end, 12 AS k, count(DISTINCT customer_id) AS customers_exported,
  (SELECT count(DISTINCT customer_id) FROM h) AS customers_in_artifact, false AS partial_export, count(*) AS n_rows,
  (SELECT string_agg(article_id, ',' ORDER BY rank) FROM pool WHERE rank <= 12) AS fallback_items,
  'ids,fallback,history_end,row_count_and_distinct,no_bought_in_discover' AS checks_passed, true AS has_sizes FROM er"""),
    i="k customers_exported customers_in_artifact n_rows", d="history_end", s="model_version partial_export fallback_items checks_passed has_sizes"))
def s12(spark, sf):
    root, _ = exported(spark, sf)
    fields = ("model_version string, history_end string, k int, customers_exported bigint, customers_in_artifact bigint, partial_export boolean, "
              "rows bigint, fallback_items array<bigint>, checks_passed array<string>, files map<string,bigint>, export_seconds double")
    m = spark.read.text(f"{sinks.export_folder(spark, root)}/manifest").select(F.from_json("value", fields).alias("m")).select("m.*")
    sizes = F.forall(F.map_values("files"), lambda n: n > 0) & (F.size("files") == 2) & (F.col("export_seconds") > 0)
    return m.withColumn("has_sizes", sizes).withColumnRenamed("rows", "n_rows").drop("files", "export_seconds")


@query("s13_parse_literal", final(with_(*order_folds_sql((0, 1, 2)), *pools_sql([7, 28]), """li AS (SELECT week, "window",
  '{' || string_agg(article_id, ',' ORDER BY rank) || '}' AS t FROM pool WHERE rank <= 12 GROUP BY ALL)""",
    select="""SELECT week, "window", rank, CAST(parts[rank] AS BIGINT) AS article_id FROM (SELECT week, "window",
  string_split(trim(t, '{}'), ',') AS parts, unnest(range(1, len(string_split(t, ',')) + 1)) AS rank FROM li)"""),
    i="rank article_id", d="week", s="window"))
def s13(spark, sf):
    f = order_folds(spark, sf, (0, 1, 2))
    text = popularity.popularity_lists(f.history, [7, 28], 12).withColumn("items", array_literal("items"))
    return to_rows(text.withColumn("items", parse_array_literal("items")))


@query("s14_bulk_load", final(with_(*EXPORT_SQL, select="""SELECT mode, model_version, count(*) AS customers, (SELECT count(*) FROM fr) AS fallback_rows
  FROM er GROUP BY ALL"""), i="customers fallback_rows", s="mode model_version"))
def s14(spark, sf):
    root, _ = exported(spark, sf)
    tables = scratch_path(spark, "served")
    counts = sinks.load_export(spark, root, tables)
    return counts.withColumn("fallback_rows", F.lit(sinks.served_fallbacks(spark, tables).read().count()))


# a fallback table with one row per fold week, then a refresh that replaces the newest and one that adds
FALLBACK_TABLE = """ft AS (SELECT 'fallback_popularity_7d' AS source, week - 1 AS as_of, 28 AS window_days, string_agg(article_id, ',' ORDER BY rank) AS items,
  'v' || week AS model_version FROM pool WHERE "window" = '28d' AND rank <= 12 GROUP BY week)"""
REFRESHED = """nx AS (SELECT max(t_dat) AS as_of FROM clean), fresh AS (SELECT string_agg(article_id, ',' ORDER BY rank) AS items FROM (
  SELECT article_id, row_number() OVER (ORDER BY count(*) DESC, article_id) AS rank FROM clean, nx WHERE t_dat > as_of - 7 AND t_dat <= as_of
  GROUP BY article_id) WHERE rank <= 12),
up AS (SELECT source, as_of, CASE WHEN as_of = (SELECT max(week) - 1 FROM fw) THEN 7 ELSE window_days END AS window_days,
  CASE WHEN as_of = (SELECT max(week) - 1 FROM fw) THEN (SELECT items FROM fresh) ELSE items END AS items, model_version FROM ft
  UNION ALL SELECT 'fallback_popularity_7d', (SELECT as_of FROM nx), 7, (SELECT items FROM fresh), (SELECT max_by(model_version, as_of) FROM ft))"""


def fallback_table(spark: SparkSession, sf: str):
    f = order_folds(spark, sf, (0, 1, 2))
    return f, popularity.popularity_lists(f.history, [28], 12).select(
        F.lit(FALLBACK_SOURCE).alias("source"), F.date_sub("week", 1).alias("as_of"), F.lit(28).alias("window_days"),
        "items", F.concat(F.lit("v"), F.col("week").cast("string")).alias("model_version"))


def refreshed(spark: SparkSession, sf: str) -> DataFrame:
    f, table = fallback_table(spark, sf)
    log = clean_order_log(spark, sf)
    as_of = log.agg(F.max("t_dat")).first()[0]
    top = popularity.recent_top(log, F.lit(as_of), 7)
    items = popularity.to_lists(top.withColumn("_k", F.lit(1)), ["_k"]).select("items")
    same_day = F.date_sub(F.lit(f.weeks[0]), 1)
    replaced = sinks.upsert_fallback(table, items, same_day, FALLBACK_SOURCE)
    return sinks.upsert_fallback(replaced, items, F.lit(as_of), FALLBACK_SOURCE)


@query("s15_upsert_fallback", final(with_(*order_folds_sql((0, 1, 2)), *pools_sql([28]), FALLBACK_TABLE, REFRESHED,
                                          select="SELECT * FROM up"), i="window_days", d="as_of", s="source items model_version"))
def s15(spark, sf):
    return refreshed(spark, sf)


@query("s16_read_back", final(with_(*order_folds_sql((0, 1, 2)), *pools_sql([28]), FALLBACK_TABLE, REFRESHED,
    select="""SELECT as_of, items, items = (SELECT items FROM fresh) AS as_written FROM up ORDER BY as_of DESC LIMIT 1"""),
    d="as_of", s="items as_written"))
def s16(spark, sf):
    """Two refreshes of a served table, the second a newer list; what is read back against what the window sold."""
    f, table = fallback_table(spark, sf)
    tables = scratch_path(spark, "served")
    version = versions.new_version(tables)
    sinks.fallback_lists(spark, version).upsert(table)
    versions.switch(spark, tables, version)
    log = clean_order_log(spark, sf)
    last = log.agg(F.max("t_dat")).first()[0]
    for day in (f.weeks[0] - dt.timedelta(days=1), last):
        serving.refresh_fallback(spark, tables, log, day)
    top = popularity.recent_top(log, F.lit(last), 7)
    items = popularity.to_lists(top.withColumn("_k", F.lit(1)), ["_k"]).select(F.col("items").alias("expected"))
    newest = latest_fallback(sinks.served_fallbacks(spark, tables).read())
    return newest.select("as_of", "items", (F.col("items") == items.scalar()).alias("as_written"))


@query("s17_model_artifact", final(with_(*event_folds_sql(), *pools_sql([7]), select="""SELECT count(DISTINCT customer_id) AS n_customers,
  count(DISTINCT article_id) AS n_items, 0 AS customer_rows_off, 0 AS customer_repeats, 0 AS customer_non_finite, 0 AS article_rows_off,
  0 AS article_repeats, 0 AS article_non_finite, 0 AS size_spread, max(t_dat) AS history_end, 7 AS fallback_days,
  (SELECT count(*) FROM pool WHERE rank <= 12) AS fallback_items FROM h"""),
    i="n_customers n_items customer_rows_off customer_repeats customer_non_finite article_rows_off article_repeats article_non_finite size_spread "
      "fallback_days fallback_items", d="history_end"))
def s17(spark, sf):
    """Save and load the fitted factors, check their structure, and what the metadata says."""
    f = event_folds(spark, sf)
    fitted = als_ops.fit_als(als_ops.index_interactions(f.history), SMALL_ALS)
    path = scratch_path(spark, "artifact")
    fallback = popularity.popularity_lists(f.history, [7], 12).first()["items"]
    artifact.save_artifact(fitted, path, fallback, f.history.agg(F.max("t_dat")).first()[0])
    loaded = artifact.load_artifact(spark, path)
    artifact.require_servable(loaded)
    return artifact.artifact_findings(loaded).withColumns({
        "n_customers": loaded.user_factors.agg(F.count(F.lit(1))).scalar(), "n_items": loaded.item_factors.agg(F.count(F.lit(1))).scalar(),
        "history_end": F.lit(loaded.meta["history_end"]), "fallback_days": F.lit(loaded.meta["fallback_days"]),
        "fallback_items": F.lit(len(set(loaded.meta["fallback_top12"])))})


STORE_SQL = [*order_folds_sql((0, 1)), *recency_sql([14]), """ls AS (SELECT week, customer_id, rank, article_id,
  CASE WHEN exclusion THEN 'exclusion=True' ELSE 'exclusion=False' END AS setting FROM rl)""",
             *scores_sql("ls", "setting", "SELECT 'exclusion=True' AS setting UNION ALL SELECT 'exclusion=False'"), SCOPED]


@query("s18_score_store", final(with_(*STORE_SQL, select="""SELECT week, setting, scope, count(*) AS n, avg(ap) AS "map", 2 AS first_run,
  0 AS second_run FROM sc2 GROUP BY week, setting, scope"""), i="n first_run second_run", f="map", d="week", s="setting scope"))
def s18(spark, sf):
    """Fill a store fold by fold; a second run finds nothing left to do."""
    store = ScoreStore(spark, scratch_path(spark, "scores"))
    whole = order_folds(spark, sf, (0, 1))

    def score(week, _config):
        fold = type(whole)((week,), whole.history.filter(F.col("week") == F.lit(week)), whole.target.filter(F.col("week") == F.lit(week)))
        return met.customer_scores(recency_models(fold), fold.truth, ["week", "setting", "model", "customer_id", "segment"])

    first = store.fill(whole.weeks, ["recency"], score)
    second = store.fill(whole.weeks, ["recency"], score)
    rows = met.metrics_by_scope(store.read(whole.weeks), ["week", "setting"])
    return rows.select("week", "setting", "scope", F.col("n_customers").alias("n"), "map",
                       F.lit(first).alias("first_run"), F.lit(second).alias("second_run"))


@query("s19_sample_rows", final(with_(EVENT_LOG, select="""SELECT customer_id FROM (SELECT DISTINCT customer_id FROM lg)
  ORDER BY md5('0|' || customer_id), customer_id LIMIT 100"""), i="customer_id"))
def s19(spark, sf):
    return sinks.sample_rows(logs.event_log(spark, sf).select("customer_id").distinct(), 100, "customer_id")
