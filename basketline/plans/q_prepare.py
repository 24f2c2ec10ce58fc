"""Queries over cleaning, ids, splits, folds and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.operators import candidates as cand
from basketline.operators import features as feat
from basketline.operators import folds as fold_ops
from basketline.operators import guards, popularity, prepare, ranker
from basketline.operators.metrics import customer_scores, map_by_positions
from basketline.operators.itemitem import ItemItem
from basketline.plans import reranking
from basketline.plans.registry import (clean_event_log, clean_order_log, CLEAN, EVENT_LOG, ORDER_LOG, event_folds, event_folds_sql, final, item_item_sql,
                                       order_folds, order_folds_sql, pools_sql, query, scores_sql, with_)
from basketline.sources import logs

CUSTOMERS = """cu AS (SELECT c_custkey AS customer_id, CASE WHEN c_acctbal > 5000 THEN 1.0 END AS fn,
  CASE WHEN c_acctbal > 7500 THEN 1.0 END AS act, nullif(c_mktsegment, 'HOUSEHOLD') AS club,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'None' WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS news,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS age FROM customer)"""


@query("p1_duplicate_rows", final(with_(EVENT_LOG, "twice AS (SELECT * FROM lg UNION ALL SELECT * FROM lg WHERE article_id % 5 = 0)",
    select="""SELECT sum(n) AS n_rows, sum(n - 1) AS n_duplicates FROM (SELECT customer_id, article_id, t_dat, price, sales_channel_id, count(*) AS n
  FROM twice GROUP BY ALL)"""), i="n_rows n_duplicates"))
def p1(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that repeat another in every column; a fifth of the articles' rows is put in twice."""
    log = logs.event_log(spark, sf)
    return prepare.duplicate_rows(log.unionByName(log.where("article_id % 5 = 0")), log.columns)


# the type of an event is the key that may be missing: an article only where the event is a purchase or a view
PARTIAL = """lp AS (SELECT user_id AS customer_id, CASE WHEN event_type IN ('purchase', 'view') THEN
  CAST(json_extract_string(props, '$.k') AS BIGINT) END AS article_id, CAST(ts AS DATE) AS t_dat,
  CASE WHEN event_type = 'view' THEN 0 ELSE value END AS price FROM events)"""


def partial_log(spark: SparkSession, sf: str) -> DataFrame:
    """All events as a raw log: no article unless viewed or bought, and views cost nothing."""
    kind = F.col("event_type")
    return logs.table(spark, sf, "events").select(
        F.col("user_id").alias("customer_id"),
        F.when(kind.isin("purchase", "view"), F.get_json_object("props", "$.k").cast("bigint")).alias("article_id"),
        F.to_date("ts").alias("t_dat"), F.when(kind == "view", 0.0).otherwise(F.col("value")).alias("price"))


BY_DAY = "count(*) AS n, count(DISTINCT customer_id) AS n_customers, sum(price) AS price"


def by_day(log: DataFrame) -> DataFrame:
    return log.groupBy("t_dat").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("customer_id").alias("n_customers"),
                                    F.sum("price").alias("price"))


@query("p2_drop_missing_keys", final(with_(PARTIAL, select=f"""SELECT t_dat, {BY_DAY} FROM lp WHERE customer_id IS NOT NULL
  AND article_id IS NOT NULL AND t_dat IS NOT NULL GROUP BY t_dat"""), i="n n_customers", f="price", d="t_dat"))
def p2(spark, sf):
    return by_day(prepare.drop_missing_keys(partial_log(spark, sf)))


@query("p3_positive_price", final(with_(PARTIAL, select=f"SELECT t_dat, {BY_DAY} FROM lp WHERE price > 0 GROUP BY t_dat"),
                                  i="n n_customers", f="price", d="t_dat"))
def p3(spark, sf):
    return by_day(prepare.keep_positive_price(partial_log(spark, sf)))


@query("p4_cleaning_breakdown", final(with_(PARTIAL, select="""SELECT n_before, miss AS n_missing_key, bad AS n_bad_price,
  miss + bad AS n_dropped, 100 * miss / n_before AS pct_missing_key, 100 * bad / n_before AS pct_bad_price FROM (
  SELECT count(*) AS n_before, count(*) FILTER (article_id IS NULL) AS miss,
  count(*) FILTER (article_id IS NOT NULL AND NOT coalesce(price > 0, false)) AS bad FROM lp)"""),
    i="n_before n_missing_key n_bad_price n_dropped", f="pct_missing_key pct_bad_price"))
def p4(spark, sf):
    return prepare.cleaning_breakdown(partial_log(spark, sf))


@query("p5_first_per_key", final(with_(EVENT_LOG, select="""SELECT customer_id, t_dat, article_id, price FROM (SELECT *,
  row_number() OVER (PARTITION BY customer_id ORDER BY t_dat, article_id, price) AS rn FROM lg) WHERE rn = 1"""),
    i="customer_id article_id", f="price", d="t_dat"))
def p5(spark, sf):
    log = logs.event_log(spark, sf).drop("sales_channel_id")
    return prepare.first_per_key(log, "customer_id", ["t_dat", "article_id", "price"])


@query("p6_flags", final(with_(CUSTOMERS, select="""SELECT customer_id, coalesce(fn, 0)::INT AS "FN",
  coalesce(act, 0)::INT AS "Active" FROM cu"""), i="customer_id FN Active"))
def p6(spark, sf):
    return prepare.fill_flags(logs.customers(spark, sf)).select("customer_id", "FN", "Active")


@query("p7_categories", final(with_(CUSTOMERS, select="""SELECT customer_id, coalesce(club, 'UNKNOWN') AS club_member_status,
  CASE coalesce(news, 'NONE') WHEN 'None' THEN 'NONE' ELSE coalesce(news, 'NONE') END AS fashion_news_frequency FROM cu"""),
    i="customer_id", s="club_member_status fashion_news_frequency"))
def p7(spark, sf):
    return prepare.fill_categories(logs.customers(spark, sf)).select("customer_id", "club_member_status", "fashion_news_frequency")


@query("p8_impute_age", final(with_(CUSTOMERS, select="""SELECT customer_id, coalesce(age, (SELECT median(age) FROM cu)) AS age,
  (age IS NULL)::INT AS age_missing FROM cu"""), i="customer_id age_missing", f="age"))
def p8(spark, sf):
    return prepare.impute_age(logs.customers(spark, sf)).select("customer_id", "age", "age_missing")


@query("p9_drop_text_columns", final("""SELECT p_partkey AS article_id, p_brand AS product_group_name,
  p_type AS department_name, p_size AS section_no FROM part""", i="article_id section_no", s="product_group_name department_name"))
def p9(spark, sf):
    return prepare.clean_articles(logs.articles(spark, sf))


HASHED = "SELECT sha256(CAST(c_custkey AS VARCHAR)) AS customer_id FROM customer"


def hashed_customers(spark: SparkSession, sf: str) -> DataFrame:
    return logs.customers(spark, sf).withColumn("customer_id", logs.hashed_id("customer_id"))


@query("p10_customer_id_lookup", final(f"SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS customer_idx FROM ({HASHED})",
                                       i="customer_idx", s="customer_id"))
def p10(spark, sf):
    return prepare.customer_id_lookup(hashed_customers(spark, sf))


@query("p11_apply_customer_idx", final(with_(
    f"lu AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS customer_idx FROM ({HASHED}))", ORDER_LOG,
    select="""SELECT customer_idx, count(*) AS n, max(t_dat) AS last_day FROM lg
  JOIN lu ON lu.customer_id = sha256(CAST(lg.customer_id AS VARCHAR)) GROUP BY ALL"""), i="customer_idx n", d="last_day"))
def p11(spark, sf):
    log = logs.order_log(spark, sf).withColumn("customer_id", logs.hashed_id("customer_id"))
    known = prepare.apply_customer_idx(log, prepare.customer_id_lookup(hashed_customers(spark, sf)))
    return known.groupBy("customer_idx").agg(F.count(F.lit(1)).alias("n"), F.max("t_dat").alias("last_day"))


@query("p11_unmapped_customers", final(with_(ORDER_LOG, """few AS (SELECT c_custkey AS customer_id FROM customer WHERE c_acctbal >= 0)""",
    """miss AS (SELECT lg.customer_id, count(*) AS n FROM lg ANTI JOIN few USING (customer_id) GROUP BY ALL)""",
    select="""SELECT coalesce(sum(n), 0) AS n_rows, count(*) AS n_customers, (SELECT string_agg(customer_id, ',' ORDER BY customer_id)
  FROM (SELECT customer_id FROM miss ORDER BY customer_id LIMIT 5)) AS examples FROM miss"""), i="n_rows n_customers", s="examples"))
def p11_unmapped(spark, sf):
    few = logs.customers(spark, sf).filter(F.col("age").isNotNull()).select("customer_id", F.lit(0).alias("customer_idx"))
    return prepare.unmapped_customers(logs.order_log(spark, sf), few)


SPLIT = """sp AS (SELECT *, CASE WHEN t_dat < mx - 13 THEN 'train' WHEN t_dat < mx - 6 THEN 'val' ELSE 'test' END AS split
  FROM clean, (SELECT max(t_dat) AS mx FROM clean))"""


def split_log(spark: SparkSession, sf: str) -> DataFrame:
    return fold_ops.temporal_split(clean_order_log(spark, sf))


@query("p12_temporal_split", final(with_(ORDER_LOG, CLEAN, SPLIT, select="""SELECT split, count(*) AS n, min(t_dat) AS first_day,
  max(t_dat) AS last_day, avg(price) AS price FROM sp GROUP BY split"""), i="n", f="price", d="first_day last_day", s="split"))
def p12(spark, sf):
    return split_log(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_dat").alias("first_day"), F.max("t_dat").alias("last_day"),
        F.avg("price").alias("price"))


@query("p13_split_conservation", final(with_(ORDER_LOG, CLEAN, SPLIT, select="""SELECT (SELECT count(*) FROM clean) AS n_clean,
  sum(n) AS n_split, count(*) AS n_splits, sum(n) = (SELECT count(*) FROM clean) AS conserved
  FROM (SELECT split, count(*) AS n FROM sp GROUP BY split)"""), i="n_clean n_split n_splits", s="conserved"))
def p13(spark, sf):
    parts = fold_ops.split_counts(split_log(spark, sf)).agg(F.sum("n").alias("n_split"), F.count(F.lit(1)).alias("n_splits"))
    whole = clean_order_log(spark, sf).agg(F.count(F.lit(1)).alias("n_clean"))
    return guards.side_by_side(whole, parts).withColumn("conserved", F.col("n_clean") == F.col("n_split"))


WEEK_ROWS = """SELECT week, role, count(*) AS n, count(DISTINCT customer_id) AS n_customers, min(t_dat) AS first_day, max(t_dat) AS last_day
  FROM (SELECT 'history' AS role, * FROM h UNION ALL SELECT 'target', * FROM t) GROUP BY week, role"""


@query("p14_weekly_folds", final(with_(*event_folds_sql((0, 1, 2)), select=WEEK_ROWS), i="n n_customers",
                                 d="week first_day last_day", s="role"))
def p14(spark, sf):
    f = event_folds(spark, sf, (0, 1, 2))
    fold_ops.check_folds(f)
    rows = f.history.withColumn("role", F.lit("history")).unionByName(f.target.withColumn("role", F.lit("target")))
    return rows.groupBy("week", "role").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("customer_id").alias("n_customers"),
        F.min("t_dat").alias("first_day"), F.max("t_dat").alias("last_day"))


@query("p15_point_in_time_guard", final(with_(*event_folds_sql((0, 1)), select="""SELECT week, max(t_dat) < week AS history_ok,
  (SELECT max(t_dat) FROM clean) >= week AS whole_log_refused FROM h GROUP BY week"""), d="week", s="history_ok whole_log_refused"))
def p15(spark, sf):
    f = event_folds(spark, sf, (0, 1))
    for week in f.weeks:
        fold_ops.refuse_leak(f.history.filter(F.col("week") == F.lit(week)), week)
    last = clean_event_log(spark, sf).agg(F.max("t_dat")).scalar()
    return f.history.groupBy("week").agg((F.max("t_dat") < F.col("week")).alias("history_ok")).withColumn(
        "whole_log_refused", last >= F.col("week"))


@query("p16_product_codes", final("SELECT p_partkey // 1000 AS product_code, count(*) AS n_articles FROM part GROUP BY ALL",
                                  i="product_code n_articles"))
def p16(spark, sf):
    return prepare.product_codes(logs.articles(spark, sf))


@query("p17_segments", final(with_(*order_folds_sql((0, 1)), select="SELECT week, customer_id, n_purchases, segment FROM cust"),
                             i="customer_id n_purchases", d="week", s="segment"))
def p17(spark, sf):
    return order_folds(spark, sf, (0, 1)).segmented_customers()


@query("p17_segments_whole_history", final(with_(*event_folds_sql((0, 1)), select="SELECT week, customer_id, n_purchases, segment FROM cust"),
                                           i="customer_id n_purchases", d="week", s="segment"))
def p17_whole(spark, sf):
    return event_folds(spark, sf, (0, 1)).segmented_customers()


# candidates with item-item lists as the personal source (n = 20, pop 12, own last 28 days)
CAND_N, CAND_POP, CAND_RECENT = 20, 12, 28


def candidates_sql() -> list[str]:
    return [*event_folds_sql(), *pools_sql([7]), *item_item_sql(CAND_N),
            f"""src AS (SELECT week, customer_id, article_id, 0 AS kind, 'ii' AS tag, -rank AS score, rank FROM iil JOIN cust USING (customer_id)
    WHERE NOT exclusion
  UNION ALL SELECT c.week, c.customer_id, article_id, 0, 'pop', NULL, rank FROM cust c JOIN pool USING (week)
    WHERE rank <= {CAND_N} AND c.customer_id NOT IN (SELECT customer_id FROM known)
  UNION ALL SELECT c.week, c.customer_id, article_id, 1, 'pop{CAND_POP}', NULL, NULL FROM cust c JOIN pool USING (week) WHERE rank <= {CAND_POP}
  UNION ALL SELECT DISTINCT h.week, customer_id, article_id, 2, 'recent', NULL::BIGINT, NULL::BIGINT FROM h JOIN hend USING (week)
    JOIN cust USING (week, customer_id) WHERE t_dat >= he - {CAND_RECENT - 1})""",
            """cd AS (SELECT s.week, s.customer_id, s.article_id, string_agg(tag, '+' ORDER BY kind) AS source,
  CAST(max(score) AS DOUBLE) AS als_score, max(rank) AS source_rank, max(CASE WHEN tr.article_id IS NULL THEN 0 ELSE 1 END) AS label
  FROM src s LEFT JOIN truth tr ON tr.week = s.week AND tr.customer_id = s.customer_id AND tr.article_id = s.article_id
  GROUP BY s.week, s.customer_id, s.article_id)"""]


def event_candidates(spark: SparkSession, sf: str):
    f = event_folds(spark, sf)
    personal = reranking.item_item_personal(f, CAND_N)
    return f, reranking.labelled_candidates(f, personal, CAND_N, CAND_POP, CAND_RECENT, "ii")


@query("p18_source_flags", final(with_(*candidates_sql(), select="""SELECT customer_id, article_id, source, contains(source, 'ii')::INT AS src_als,
  contains(source, 'pop')::INT AS src_pop, contains(source, 'recent')::INT AS src_recent FROM cd"""),
    i="customer_id article_id src_als src_pop src_recent", s="source"))
def p18(spark, sf):
    _, rows = event_candidates(spark, sf)
    return feat.source_flags(rows, "ii").select("customer_id", "article_id", "source", "src_als", "src_pop", "src_recent")


@query("p19_personal_only", final(with_(*candidates_sql(), select="""SELECT customer_id, article_id,
  CASE WHEN contains(source, 'ii') THEN source_rank END AS als_rank, CASE WHEN contains(source, 'ii') THEN als_score END AS als_score FROM cd"""),
    i="customer_id article_id", f="als_rank als_score"))
def p19(spark, sf):
    _, rows = event_candidates(spark, sf)
    return feat.personal_only(feat.source_flags(rows, "ii")).select("customer_id", "article_id", "als_rank", "als_score")


BOUGHT = "(SELECT customer_id, article_id, count(*) AS ci_count FROM h GROUP BY ALL)"


def with_ci(f, rows):
    pairs = feat.customer_item_features(f.history, rows, f.weeks[0]).select("customer_id", "article_id", "ci_count")
    return rows.join(pairs, ["customer_id", "article_id"], "left").withColumn("ci_count", F.coalesce("ci_count", F.lit(0)))


@query("p20_discover_only", final(with_(*candidates_sql(), select=f"""SELECT cd.customer_id, cd.article_id, source, label
  FROM cd ANTI JOIN {BOUGHT} b USING (customer_id, article_id)"""), i="customer_id article_id label", s="source"))
def p20(spark, sf):
    f, rows = event_candidates(spark, sf)
    return ranker.discover_only(with_ci(f, rows)).select("customer_id", "article_id", "source", "label")


@query("p21_groups_with_positive", final(with_(*candidates_sql(), select="""SELECT customer_id, article_id, label FROM (SELECT *,
  max(label) OVER (PARTITION BY week, customer_id) AS any_hit FROM cd) WHERE any_hit > 0"""), i="customer_id article_id label"))
def p21(spark, sf):
    _, rows = event_candidates(spark, sf)
    return ranker.with_positive(rows).select("customer_id", "article_id", "label")


# cold rows need customers the personal model does not know: the last order week has them
def order_candidates_sql() -> list[str]:
    return [*order_folds_sql(), *pools_sql([7]),
            """src AS (SELECT c.week, c.customer_id, article_id, 0 AS kind, 'pop' AS tag, rank FROM cust c JOIN pool USING (week)
    WHERE rank <= 20 AND n_purchases = 0
  UNION ALL SELECT DISTINCT week, customer_id, article_id, 0, 'ii', 1 FROM h JOIN cust USING (week, customer_id)
  UNION ALL SELECT c.week, c.customer_id, article_id, 1, 'pop12', NULL FROM cust c JOIN pool USING (week) WHERE rank <= 12)""",
            """cd AS (SELECT week, customer_id, article_id, string_agg(tag, '+' ORDER BY kind) AS source, max(rank) AS source_rank
  FROM src GROUP BY ALL)"""]


def order_candidates(spark: SparkSession, sf: str):
    """Owned articles as the personal source, so customers without history are the cold ones."""
    f = order_folds(spark, sf)
    own = (f.history.select("week", "customer_id", "article_id").distinct()
           .join(f.customers, ["week", "customer_id"], "left_semi").select("*", F.lit(0.0).alias("score"), F.lit(1).alias("rank")))
    return f, cand.candidate_rows(f.history, f.customers, f.truth, own, 20, 12, 0, "ii")


@query("p22_cold_rows", final(with_(*order_candidates_sql(), select="""SELECT customer_id, article_id, source, source_rank FROM cd
  WHERE NOT contains(source, 'ii') AND starts_with(source, 'pop') AND source_rank IS NOT NULL"""),
    i="customer_id article_id", f="source_rank", s="source"))
def p22(spark, sf):
    _, rows = order_candidates(spark, sf)
    return ranker.cold_rows(feat.source_flags(rows, "ii")).select("customer_id", "article_id", "source", "source_rank")


# requests derived from the customers: hashed, upper-cased or plain ids, with and without a mode
REQUESTS = """rq AS (SELECT c_custkey AS request_id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN upper(hx) WHEN 'MACHINERY' THEN ' ' || hx
  WHEN 'FURNITURE' THEN CAST(c_custkey AS VARCHAR) ELSE hx END AS customer_id,
  CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 3000 THEN 'discover' WHEN c_acctbal < 8000 THEN 'repurchase' ELSE 'other' END AS mode
  FROM (SELECT *, sha256(CAST(c_custkey AS VARCHAR)) AS hx FROM customer))"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    c = logs.table(spark, sf, "customer").withColumn("hx", logs.hashed_id("c_custkey"))
    kind, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    sent = (F.when(kind == "HOUSEHOLD", F.upper("hx")).when(kind == "MACHINERY", F.concat(F.lit(" "), "hx"))
            .when(kind == "FURNITURE", F.col("c_custkey").cast("string")).otherwise(F.col("hx")))
    mode = (F.when(balance < 0, F.lit(None).cast("string")).when(balance < 3000, "discover")
            .when(balance < 8000, "repurchase").otherwise("other"))
    return c.select(F.col("c_custkey").alias("request_id"), sent.alias("customer_id"), mode.alias("mode"))


STATUS = """CASE WHEN regexp_full_match(customer_id, '[0-9a-f]{64}') AND coalesce(mode, 'repurchase') IN ('repurchase', 'discover')
  THEN 200 ELSE 400 END"""


@query("p23_request_status", final(with_(REQUESTS, select=f"SELECT request_id, coalesce(mode, 'repurchase') AS mode, {STATUS} AS status FROM rq"),
                                   i="request_id status", s="mode"))
def p23(spark, sf):
    status = guards.request_status(F.col("customer_id"), F.col("mode"))
    return requests(spark, sf).select("request_id", F.coalesce("mode", F.lit(guards.DEFAULT_MODE)).alias("mode"), status.alias("status"))


@query("v1_id_checks", final(with_(REQUESTS, """ar AS (SELECT CAST(p_partkey AS VARCHAR) AS article_id FROM part
  UNION ALL SELECT p_brand FROM part)""", select="""SELECT * FROM (SELECT count(*) AS n_customers,
  count(*) FILTER (NOT regexp_full_match(customer_id, '[0-9a-f]{64}')) AS bad_customer_ids,
  count(customer_id) - count(DISTINCT customer_id) AS repeated_customer_ids FROM rq),
  (SELECT count(*) AS n_articles, count(*) FILTER (TRY_CAST(article_id AS BIGINT) IS NULL) AS bad_article_ids,
  count(TRY_CAST(article_id AS BIGINT)) - count(DISTINCT TRY_CAST(article_id AS BIGINT)) AS repeated_article_ids FROM ar)"""),
    i="n_customers bad_customer_ids repeated_customer_ids n_articles bad_article_ids repeated_article_ids"))
def v1(spark, sf):
    p = logs.table(spark, sf, "part")
    mixed = p.select(F.col("p_partkey").cast("string").alias("article_id")).unionByName(p.select(F.col("p_brand").alias("article_id")))
    return guards.id_checks(requests(spark, sf), mixed)


@query("v2_list_checks", final(with_(*order_folds_sql((0, 1, 2)), *pools_sql([7, 28]),
    "cat AS (SELECT p_partkey AS article_id FROM part WHERE p_size > 10)",
    select="""SELECT week, "window", count(*) AS n_items, count(DISTINCT article_id) AS n_distinct, count(*) FILTER (bad) AS n_missing,
  count(*) = 12 AND count(DISTINCT article_id) = 12 AND count(*) FILTER (bad) = 0 AS ok FROM (SELECT *, article_id NOT IN
  (SELECT article_id FROM cat) AS bad FROM pool WHERE rank <= 12) GROUP BY ALL"""),
    i="n_items n_distinct n_missing", d="week", s="window ok"))
def v2(spark, sf):
    f = order_folds(spark, sf, (0, 1, 2))
    lists = popularity.popularity_lists(f.history, [7, 28], 12)
    known = logs.articles(spark, sf).filter(F.col("section_no") > 10)  # a catalogue that lacks some sold articles
    return guards.list_checks(lists, ["week", "window"], known)


def both_modes(spark: SparkSession, sf: str):
    """Item-item lists of the event log's target customers as repurchase / discover exports."""
    f = event_folds(spark, sf)
    lists = ItemItem(f.history).recommend(f.customers)
    mode = F.when(F.col("exclusion"), "discover").otherwise("repurchase")
    return f, lists.select("customer_id", mode.alias("mode"), "items")


EXPORT = "ex AS (SELECT customer_id, CASE WHEN exclusion THEN 'discover' ELSE 'repurchase' END AS mode, rank, article_id FROM iil)"


@query("v3_export_checks", final(with_(*event_folds_sql(), *item_item_sql(), EXPORT,
    "li AS (SELECT customer_id, mode, count(*) AS n, count(DISTINCT article_id) AS nd FROM ex GROUP BY ALL)",
    select="""SELECT (SELECT count(*) FROM li) AS n_rows, (SELECT count(*) FROM li WHERE n <> 12) AS wrong_size,
  (SELECT count(*) FROM li WHERE n <> nd) AS with_repeats, (SELECT count(*) FROM ex SEMI JOIN h USING (customer_id, article_id)
   WHERE mode = 'discover') AS owned_in_discover, count(*) AS n_customers, count(*) FILTER (m <> 2) AS without_both_modes
  FROM (SELECT customer_id, count(*) AS m FROM li GROUP BY ALL)"""),
    i="n_rows wrong_size with_repeats owned_in_discover n_customers without_both_modes"))
def v3(spark, sf):
    f, lists = both_modes(spark, sf)
    return guards.export_checks(lists, f.history.select("customer_id", "article_id").distinct())


@query("v4_refresh_guard", final(with_(ORDER_LOG, CLEAN, """dd AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS as_of FROM lineitem)""",
    """bd AS (SELECT min(t_dat) AS lo, max(t_dat) AS hi, max(t_dat) - 28 AS latest FROM clean)""",
    select="""SELECT as_of, CASE WHEN as_of > hi THEN 'future day' WHEN as_of - 7 < lo THEN 'window not covered'
  WHEN as_of < latest THEN 'list already newer' ELSE 'ok' END AS reason FROM dd, bd"""), d="as_of", s="reason"))
def v4(spark, sf):
    days = logs.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("as_of")).distinct()
    log = clean_order_log(spark, sf)
    low, high = log.agg(F.min("t_dat")).scalar(), log.agg(F.max("t_dat")).scalar()
    return days.select("as_of", guards.refresh_reason(F.col("as_of"), low, high, F.date_sub(high, 28)).alias("reason"))


@query("v5_structure_checks", final("""SELECT count(*) AS n_rows, min(len(embedding)) AS min_size, max(len(embedding)) AS max_size,
  count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS non_finite,
  count(vec_id) - count(DISTINCT vec_id) AS repeated_ids,
  count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero_vectors FROM embeddings""",
    i="n_rows min_size max_size non_finite repeated_ids zero_vectors"))
def v5(spark, sf):
    vectors = logs.table(spark, sf, "embeddings").withColumnRenamed("embedding", "features")
    return guards.structure_checks(vectors, "vec_id")


@query("v6_history_end", final(with_(ORDER_LOG, CLEAN, select="""SELECT max(t_dat) AS history_end,
  max(t_dat) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS matches FROM clean"""), d="history_end", s="matches"))
def v6(spark, sf):
    recorded = logs.table(spark, sf, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]
    return guards.history_end_matches(clean_order_log(spark, sf), recorded)


@query("v7_list_parity", final(with_(*order_folds_sql((0, 1, 2)), *pools_sql([7, 14]),
    """ls AS (SELECT week, "window", string_agg(article_id, ',' ORDER BY rank) AS items FROM pool WHERE rank <= 12 GROUP BY ALL)""",
    """pr AS (SELECT a.items AS x, b.items AS y FROM (SELECT * FROM ls WHERE "window" = '7d') a
  FULL JOIN (SELECT * FROM ls WHERE "window" = '14d' AND week <> (SELECT max(week) FROM fw)) b USING (week))""",
    select="""SELECT count(*) AS n_keys, count(*) FILTER (y IS NULL) AS left_only, count(*) FILTER (x IS NULL) AS right_only,
  avg(CASE WHEN x = y THEN 1 ELSE 0 END) AS share_identical FROM pr"""), i="n_keys left_only right_only", f="share_identical"))
def v7(spark, sf):
    f = order_folds(spark, sf, (0, 1, 2))
    lists = popularity.popularity_lists(f.history, [7, 14], 12)
    short = lists.filter(F.col("window") == "7d")
    long = lists.filter((F.col("window") == "14d") & (F.col("week") != F.lit(f.weeks[0])))
    return guards.list_parity(short, long, ["week"])


@query("v8_metric_cross_check", final(with_(*order_folds_sql((0, 1)), *pools_sql([28]), """ls AS (SELECT c.week, c.customer_id, p.rank, p.article_id,
  'm' AS model FROM cust c JOIN pool p USING (week) WHERE p.rank <= 12)""", *scores_sql("ls", "model", "SELECT 'm' AS model"),
    select="SELECT count(*) AS n_keys, true AS agrees, avg(ap) AS mean_ap FROM sc"), i="n_keys", f="mean_ap", s="agrees"))
def v8(spark, sf):
    f = order_folds(spark, sf, (0, 1))
    lists = popularity.same_list_for_all(f.customers, popularity.popularity_lists(f.history, [28], 12)).select("week", "customer_id", "items")
    one = customer_scores(lists, f.truth, ["week", "customer_id"])
    gap = guards.value_gap(one, map_by_positions(lists, f.truth, ["week", "customer_id"]), ["week", "customer_id"], "ap")
    checked = gap.select("n_keys", (F.col("max_gap") < 1e-9).alias("agrees"))
    return guards.side_by_side(checked, one.agg(F.avg("ap").alias("mean_ap")))
