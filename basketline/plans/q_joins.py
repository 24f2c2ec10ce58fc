"""Queries over joins, set operations, windows and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketline.functions.lists import to_lists, to_rows, top_k
from basketline.operators import compare, factors, features, guards, lookup, popularity, prepare, profiling, ranker
from basketline.operators.folds import temporal_split
from basketline.operators.itemitem import with_fallback
from basketline.operators.metrics import customer_scores, hit_positions
from basketline.plans.q_prepare import (EXPORT, REQUESTS, SPLIT, both_modes, candidates_sql, event_candidates, requests)
from basketline.plans.q_sources import EXPORT_ROWS, FALLBACK_ROW, version_at
from basketline.plans.registry import (clean_order_log, CLEAN, EVENT_LOG, ORDER_LOG, event_folds, event_folds_sql, final,
                                       item_item_sql, order_folds, order_folds_sql, pools_sql, query, recency_sql, scores_sql, with_)
from basketline.sources import logs, sinks


def count_as(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


@query("j1_dictionary_lookup", final(with_(
    "lu AS (SELECT c_custkey AS customer_id, row_number() OVER (ORDER BY c_custkey) - 1 AS customer_idx FROM customer)", EVENT_LOG,
    select="SELECT customer_idx, count(*) AS n, sum(article_id) AS articles FROM lg LEFT JOIN lu USING (customer_id) GROUP BY ALL"),
    i="customer_idx n articles"))
def j1(spark: SparkSession, sf: str) -> DataFrame:
    lookup_table = prepare.customer_id_lookup(logs.customers(spark, sf))
    return (logs.event_log(spark, sf).join(lookup_table, "customer_id", "left").groupBy("customer_idx")
            .agg(count_as("n"), F.sum("article_id").alias("articles")))


@query("j2_semi_join", final(with_(*order_folds_sql((0, 1)), select="""SELECT week, customer_id, count(*) AS n, min(t_dat) AS first_day
  FROM h SEMI JOIN cust USING (week, customer_id) GROUP BY ALL"""), i="customer_id n", d="week first_day"))
def j2(spark, sf):
    f = order_folds(spark, sf, (0, 1))
    kept = f.history.join(f.customers, ["week", "customer_id"], "left_semi")
    return kept.groupBy("week", "customer_id").agg(count_as("n"), F.min("t_dat").alias("first_day"))


@query("j3_fallback_for_unknown", final(with_(*order_folds_sql((0, 1)), *pools_sql([7, 28]),
    """own AS (SELECT * FROM (SELECT week, customer_id, article_id, row_number() OVER (PARTITION BY week, customer_id
    ORDER BY count(*) DESC, article_id) AS rank FROM h GROUP BY week, customer_id, article_id) WHERE rank <= 12)""",
    select="""SELECT c.week, c.customer_id, string_agg(o.article_id, ',' ORDER BY o.rank) AS items, false AS used_fallback FROM cust c
  JOIN own o USING (week, customer_id) GROUP BY c.week, c.customer_id UNION ALL SELECT c.week, c.customer_id, string_agg(p.article_id, ',' ORDER BY p.rank), true
  FROM cust c ANTI JOIN own USING (week, customer_id) JOIN pool p ON p.week = c.week AND p."window" = '7d' AND p.rank <= 12 GROUP BY c.week, c.customer_id"""),
    i="customer_id", d="week", s="items used_fallback"))
def j3(spark, sf):
    """Own best sellers, or the 7-day list for customers without history."""
    f = order_folds(spark, sf, (0, 1))
    counts = popularity.article_counts(f.history.join(f.customers, ["week", "customer_id"], "left_semi"), ["week", "customer_id"])
    personal = to_lists(top_k(counts, ["week", "customer_id"], popularity.count_order(), 12), ["week", "customer_id"])
    marked = personal.withColumn("used_fallback", F.lit(False))
    pool = popularity.popularity_lists(f.history, [7], 12).select("week", "items")
    full = with_fallback(marked, f.customers, pool, ["week", "customer_id"])
    return full.withColumn("used_fallback", F.coalesce("used_fallback", F.lit(True)))


@query("j4_zero_fill", final(with_(*order_folds_sql(), select="""SELECT p_partkey AS article_id, coalesce(n, 0) AS cnt FROM part
  LEFT JOIN (SELECT article_id, count(*) AS n FROM h GROUP BY ALL) x ON x.article_id = p_partkey"""), i="article_id cnt"))
def j4(spark, sf):
    return profiling.counts_with_zero(logs.articles(spark, sf), order_folds(spark, sf).history, "article_id")


@query("j5_category_merge", final(with_(ORDER_LOG, select="""SELECT t_dat, p_brand AS product_group_name, count(*) AS n FROM lg
  LEFT JOIN part ON p_partkey = article_id GROUP BY ALL"""), i="n", d="t_dat", s="product_group_name"))
def j5(spark, sf):
    """Counted per day and article before the dimension is joined."""
    per_article = logs.order_log(spark, sf).groupBy("t_dat", "article_id").agg(count_as("n"))
    named = per_article.join(logs.articles(spark, sf).select("article_id", "product_group_name"), "article_id", "left")
    return named.groupBy("t_dat", "product_group_name").agg(F.sum("n").alias("n"))


ITEM_FEATURES = """itf AS (SELECT article_id, count(*) FILTER (t_dat >= week - 7) AS item_cnt_7d, count(*) AS item_cnt_28d,
  avg(price) AS item_price_mean_28d FROM h WHERE t_dat >= week - 28 GROUP BY article_id)"""
PAIR_FEATURES = """pf AS (SELECT customer_id, article_id, count(*) AS ci_count, any_value(week) - max(t_dat) AS ci_days_since FROM h
  SEMI JOIN cust USING (customer_id) GROUP BY ALL)"""
CUSTOMER_FEATURES = """cf AS (SELECT customer_id, count(*) AS cust_n_purchases, any_value(week) - max(t_dat) AS cust_days_since_last FROM h
  SEMI JOIN cust USING (customer_id) GROUP BY ALL)"""
ATTACHED = """ft AS (SELECT cd.*, coalesce(item_cnt_7d, 0) AS item_cnt_7d, coalesce(item_cnt_28d, 0) AS item_cnt_28d, item_price_mean_28d,
  coalesce(ci_count, 0) AS ci_count, ci_days_since, coalesce(cust_n_purchases, 0) AS cust_n_purchases, cust_days_since_last,
  contains(source, 'ii')::INT AS src_als, contains(source, 'pop')::INT AS src_pop, contains(source, 'recent')::INT AS src_recent,
  CASE WHEN contains(source, 'ii') THEN source_rank END AS als_rank
  FROM cd LEFT JOIN itf USING (article_id) LEFT JOIN pf USING (customer_id, article_id) LEFT JOIN cf USING (customer_id))"""
FEATURES_SQL = [*candidates_sql(), ITEM_FEATURES, PAIR_FEATURES, CUSTOMER_FEATURES, ATTACHED]


@query("j6_feature_attach", final(with_(*FEATURES_SQL, select="""SELECT customer_id, article_id, item_cnt_7d, item_cnt_28d, item_price_mean_28d,
  ci_count, ci_days_since, cust_n_purchases, cust_days_since_last FROM ft"""), i="customer_id article_id item_cnt_7d item_cnt_28d ci_count cust_n_purchases",
    f="item_price_mean_28d ci_days_since cust_days_since_last"))
def j6(spark, sf):
    f, rows = event_candidates(spark, sf)
    day = f.weeks[0]
    pairs = features.customer_item_features(f.history, rows, day)
    out = features.attach(rows, features.item_features(f.history, day), pairs, features.customer_features(pairs))
    return out.select("customer_id", "article_id", "item_cnt_7d", "item_cnt_28d", "item_price_mean_28d", "ci_count",
                      F.col("ci_days_since").cast("double").alias("ci_days_since"), "cust_n_purchases",
                      F.col("cust_days_since_last").cast("double").alias("cust_days_since_last"))


@query("j7_same_list_for_all", final(with_(*order_folds_sql((0, 1)), *recency_sql([7, 14, 28, None]),
    select='SELECT week, customer_id, "window", rank, article_id FROM plain'), i="customer_id rank article_id", d="week", s="window"))
def j7(spark, sf):
    f = order_folds(spark, sf, (0, 1))
    lists = popularity.popularity_lists(f.history, [7, 14, 28, None], 12)
    return to_rows(popularity.same_list_for_all(f.customers, lists))


@query("j8_exclusion_lists", final(with_(*order_folds_sql((0, 1)), *recency_sql([14, None]),
    select='SELECT week, customer_id, "window", rank, article_id FROM kept'), i="customer_id rank article_id", d="week", s="window"))
def j8(spark, sf):
    f = order_folds(spark, sf, (0, 1))
    return to_rows(popularity.exclusion_lists(f.customers, f.history, [14, None]))


@query("j9_lookup", final(with_(*event_folds_sql(), *pools_sql([7]), *item_item_sql(), EXPORT, EXPORT_ROWS, FALLBACK_ROW, REQUESTS,
    """st AS (SELECT request_id, customer_id, coalesce(mode, 'repurchase') AS mode, regexp_full_match(customer_id, '[0-9a-f]{64}')
    AND coalesce(mode, 'repurchase') IN ('repurchase', 'discover') AS valid FROM rq)""",
    select="""SELECT request_id, s.customer_id, s.mode, CASE WHEN valid THEN 200 ELSE 400 END AS status,
  CASE WHEN NOT valid THEN NULL WHEN e.items IS NOT NULL THEN 'als' ELSE 'fallback_popularity_7d' END AS source,
  CASE WHEN NOT valid THEN NULL ELSE coalesce(e.model_version, fr.model_version) END AS model_version,
  CASE WHEN NOT valid THEN NULL ELSE trim(coalesce(e.items, fr.items), '{}') END AS items
  FROM st s LEFT JOIN er e USING (customer_id, mode), fr"""), i="request_id status", s="customer_id mode source model_version items"))
def j9(spark, sf):
    f, lists = both_modes(spark, sf)
    end = f.history.agg(F.max("t_dat")).first()[0]
    version = version_at(spark, end)
    recs = lists.withColumn("customer_id", logs.hashed_id("customer_id")).withColumn("model_version", F.lit(version))
    fallback = sinks.fallback_row(popularity.popularity_lists(f.history, [7], 12).select("items"), F.lit(end), version, lookup.FALLBACK_SOURCE)
    return lookup.resolve(requests(spark, sf), recs, fallback)


@query("j9_lookup_no_fallback", final(with_(*event_folds_sql(), *item_item_sql(), EXPORT, EXPORT_ROWS, REQUESTS,
    select="""SELECT CASE WHEN NOT regexp_full_match(customer_id, '[0-9a-f]{64}') OR coalesce(mode, 'repurchase') NOT IN
  ('repurchase', 'discover') THEN 400 WHEN items IS NOT NULL THEN 200 ELSE 503 END AS status, count(*) AS n
  FROM (SELECT request_id, customer_id, coalesce(mode, 'repurchase') AS mode FROM rq) LEFT JOIN er USING (customer_id, mode) GROUP BY ALL"""),
    i="status n"))
def j9_no_fallback(spark, sf):
    _, lists = both_modes(spark, sf)
    recs = lists.withColumn("customer_id", logs.hashed_id("customer_id")).withColumn("model_version", F.lit("v"))
    nothing = recs.select(F.lit("other source").alias("source"), F.current_date().alias("as_of"), "items", "model_version")
    return lookup.resolve(requests(spark, sf), recs, nothing).groupBy("status").agg(count_as("n"))


LIST28 = [*order_folds_sql((0, 1)), *pools_sql([28]),
          "ls AS (SELECT c.week, c.customer_id, p.rank, p.article_id, 'm' AS model FROM cust c JOIN pool p USING (week) WHERE p.rank <= 12)"]


def list28(f):
    lists = popularity.popularity_lists(f.history, [28], 12)
    return popularity.same_list_for_all(f.segmented_customers(), lists).select("week", "customer_id", "segment", "items")


@query("j10_list_against_truth", final(with_(*LIST28, """ht AS (SELECT week, customer_id, string_agg(rank, ',' ORDER BY rank) AS positions, count(*) AS hits
    FROM ls JOIN truth USING (week, customer_id, article_id) GROUP BY ALL)""", select="""SELECT week, customer_id, count(*) AS n_true,
    coalesce(any_value(hits), 0) AS hits, coalesce(any_value(positions), '') AS positions FROM truth LEFT JOIN ht USING (week, customer_id)
    GROUP BY week, customer_id"""), i="customer_id n_true hits", d="week", s="positions"))
def j10(spark, sf):
    f = order_folds(spark, sf, (0, 1))
    return hit_positions(list28(f), f.truth, ["week", "customer_id"], 12).withColumn("hits", F.size("positions"))


PAIRED = [*order_folds_sql((0, 1)), *recency_sql([7, 14]), "ls AS (SELECT *, \"window\" AS model FROM plain)",
          *scores_sql("ls", "model", "SELECT '7d' AS model UNION ALL SELECT '14d'")]


def window_scores(f, windows=(7, 14)):
    lists = popularity.popularity_lists(f.history, list(windows), 12)
    given = popularity.same_list_for_all(f.segmented_customers(), lists).withColumnRenamed("window", "model")
    return customer_scores(given, f.truth, ["week", "model", "customer_id", "segment"])


@query("j11_paired_scores", final(with_(*PAIRED, select="""SELECT a.week, a.customer_id, a.ap AS ap_a, b.ap AS ap_b, a.ap - b.ap AS d
  FROM sc a JOIN sc b USING (week, customer_id) WHERE a.model = '14d' AND b.model = '7d'"""), i="customer_id", f="ap_a ap_b d", d="week"))
def j11(spark, sf):
    rows = compare.pair_differences(window_scores(order_folds(spark, sf, (0, 1))), [("14d", "7d")], ["week"], ("ap",))
    return rows.select("week", "customer_id", F.col("a").alias("ap_a"), F.col("b").alias("ap_b"), "d")


@query("j12_ids_back", final(with_(EVENT_LOG, """lu AS (SELECT c_custkey AS customer_id, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer)""",
    """it AS (SELECT article_id, row_number() OVER (ORDER BY article_id) - 1 AS col FROM (SELECT DISTINCT article_id FROM lg))""",
    select="SELECT customer_id, article_id, idx AS customer_idx, col AS article_idx, count(*) AS weight FROM lg JOIN lu USING (customer_id) JOIN it USING (article_id) GROUP BY ALL"),
    i="customer_id article_id customer_idx article_idx weight"))
def j12(spark, sf):
    """Numbered pairs as a saved model holds them, joined back to the ids of the data."""
    log = logs.event_log(spark, sf)
    users = prepare.customer_id_lookup(logs.customers(spark, sf))
    items = prepare.dense_index(log.select("article_id").distinct(), ["article_id"], "article_idx")
    numbered = (log.join(users, "customer_id").join(items, "article_id")
                .groupBy("customer_idx", "article_idx").agg(count_as("weight")))
    return numbered.join(users, "customer_idx").join(items, "article_idx")


@query("u1_concat_splits", final(with_(ORDER_LOG, CLEAN, SPLIT, select="""SELECT count(*) AS n, count(DISTINCT customer_id) AS n_customers,
  max(t_dat) AS history_end FROM sp WHERE split <> 'test'"""), i="n n_customers", d="history_end"))
def u1(spark, sf):
    log = temporal_split(clean_order_log(spark, sf))
    train, val = (log.filter(F.col("split") == s).drop("split") for s in ("train", "val"))
    return train.unionByName(val).agg(count_as("n"), F.countDistinct("customer_id").alias("n_customers"), F.max("t_dat").alias("history_end"))


@query("u2_candidate_union", final(with_(*candidates_sql(), select="SELECT customer_id, article_id, source, als_score, source_rank, label FROM cd"),
                                   i="customer_id article_id label", f="als_score source_rank", s="source"))
def u2(spark, sf):
    _, rows = event_candidates(spark, sf)
    return rows.drop("week")


@query("u3_list_overlap", final(with_(*order_folds_sql((0, 1, 2)), *pools_sql([7, 28]), "p AS (SELECT * FROM pool WHERE rank <= 12)",
    select="""SELECT week, (SELECT string_agg(article_id, ',' ORDER BY rank) FROM p a WHERE a.week = w.week AND "window" = '7d' AND article_id IN
  (SELECT article_id FROM p b WHERE b.week = w.week AND b."window" = '28d')) AS kept,
  (SELECT string_agg(article_id, ',' ORDER BY rank) FROM p a WHERE a.week = w.week AND "window" = '7d' AND article_id NOT IN
  (SELECT article_id FROM p b WHERE b.week = w.week AND b."window" = '28d')) AS fresh FROM fw w"""), d="week", s="kept fresh"))
def u3(spark, sf):
    lists = popularity.popularity_lists(order_folds(spark, sf, (0, 1, 2)).history, [7, 28], 12)
    short, long = (lists.filter(F.col("window") == w).select("week", F.col("items").alias(n)) for w, n in (("7d", "a"), ("28d", "b")))
    def text(c):
        return F.nullif(F.array_join(c.cast("array<string>"), ","), F.lit(""))
    return short.join(long, "week").select("week", text(F.array_intersect("a", "b")).alias("kept"), text(F.array_except("a", "b")).alias("fresh"))


@query("u4_customer_sets", final(with_(ORDER_LOG, """cl AS (SELECT DISTINCT customer_id FROM lg WHERE sales_channel_id = 1)""",
    """cr AS (SELECT DISTINCT customer_id FROM lg WHERE sales_channel_id = 2)""", select="""SELECT
  (SELECT count(*) FROM cl ANTI JOIN cr USING (customer_id)) AS only_a, (SELECT count(*) FROM cr ANTI JOIN cl USING (customer_id)) AS only_b"""),
    i="only_a only_b"))
def u4(spark, sf):
    log = logs.order_log(spark, sf)
    return guards.same_customers(log.filter("sales_channel_id = 1"), log.filter("sales_channel_id = 2"))


@query("u5_distinct_pairs", final(with_(EVENT_LOG, select="SELECT DISTINCT customer_id, article_id FROM lg"), i="customer_id article_id"))
def u5(spark, sf):
    return logs.event_log(spark, sf).select("customer_id", "article_id").distinct()


@query("w1_top_k_per_customer", final(with_(*FEATURES_SQL, select="""SELECT customer_id, rank, article_id FROM (SELECT customer_id, article_id, row_number() OVER
  (PARTITION BY customer_id ORDER BY item_cnt_28d DESC, source_rank ASC NULLS LAST, article_id) AS rank FROM ft) WHERE rank <= 12"""),
    i="customer_id rank article_id"))
def w1(spark, sf):
    f, rows = event_candidates(spark, sf)
    scored = rows.join(features.item_features(f.history, f.weeks[0]), "article_id", "left").withColumn(
        "item_cnt_28d", F.coalesce("item_cnt_28d", F.lit(0)))
    return to_rows(ranker.lists_by(scored, [F.desc("item_cnt_28d")])).drop("week")


@query("w2_running_hits", final(with_(*LIST28, select="""SELECT week, customer_id, rank, article_id, row_number() OVER (PARTITION BY week, customer_id
  ORDER BY rank) AS running_hits FROM ls JOIN truth USING (week, customer_id, article_id)"""), i="customer_id rank article_id running_hits", d="week"))
def w2(spark, sf):
    f = order_folds(spark, sf, (0, 1))
    hits = to_rows(list28(f)).join(f.truth, ["week", "customer_id", "article_id"], "left_semi")
    w = Window.partitionBy("week", "customer_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("running_hits", F.count(F.lit(1)).over(w)).drop("segment")


@query("w3_rank_positions", final(with_(*order_folds_sql((0, 1)), *pools_sql([7, None]), select='SELECT week, "window", rank, article_id FROM pool WHERE rank <= 200'),
                                  i="rank article_id", d="week", s="window"))
def w3(spark, sf):
    return to_rows(popularity.popularity_lists(order_folds(spark, sf, (0, 1)).history, [7, None], 200))


@query("w4_global_top_k", final(with_(ORDER_LOG, select="SELECT article_id, count(*) AS cnt FROM lg GROUP BY ALL ORDER BY cnt DESC, article_id LIMIT 12"),
                                i="article_id cnt"))
def w4(spark, sf):
    return popularity.article_counts(logs.order_log(spark, sf)).orderBy(*popularity.count_order()).limit(12)


MONTHS = """mo AS (SELECT (year(t_dat) - 1995) * 12 + month(t_dat) AS iteration, avg(price) AS loss FROM lg GROUP BY ALL)"""


def monthly_curve(spark, sf):
    """One value per month of the log: any (step, value) curve will do."""
    step = (F.year("t_dat") - 1995) * 12 + F.month("t_dat")
    return logs.order_log(spark, sf).groupBy(step.alias("iteration")).agg(F.avg("price").alias("loss"))


@query("w5_relative_change", final(with_(ORDER_LOG, MONTHS, select="""SELECT iteration, loss, 100 * (loss - lag(loss) OVER (ORDER BY iteration))
  / lag(loss) OVER (ORDER BY iteration) AS rel_change_pct FROM mo"""), i="iteration", f="loss rel_change_pct"))
def w5(spark, sf):
    return profiling.relative_change(monthly_curve(spark, sf), "iteration", "loss")


DOTS = """dt AS (SELECT u.vec_id AS user_id, i.vec_id AS item_id, round(list_dot_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS score
  FROM embeddings u, embeddings i)"""


def vectors(spark, sf, key):
    e = logs.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias(key), F.col("embedding").alias("features"))


def scored_rows(lists):
    """List positions with the score in billionths, the unit the scores are rounded to."""
    score = F.round(F.col("x.scores") * 1e9).cast("bigint")
    return lists.select("user_id", "mode", F.posexplode(F.arrays_zip("items", "scores")).alias("p", "x")).select(
        "user_id", "mode", (F.col("p") + 1).alias("rank"), F.col("x.items").alias("item_id"), score.alias("score"))


@query("w6_block_top_k", final(with_(DOTS, select="""SELECT user_id, 'repurchase' AS mode, rank, item_id, round(score * 1e9) AS score FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM dt) WHERE rank <= 5"""), i="user_id rank item_id score", s="mode"))
def w6(spark, sf):
    return scored_rows(factors.score_top_k(vectors(spark, sf, "user_id"), vectors(spark, sf, "item_id"), 5))


@query("w7_grouped_for_training", final(with_(*candidates_sql(), select="""SELECT week, customer_id, count(*) AS n_rows, sum(label) AS n_positive
  FROM cd GROUP BY ALL"""), i="customer_id n_rows n_positive", d="week"))
def w7(spark, sf):
    _, rows = event_candidates(spark, sf)
    return ranker.group_sizes(ranker.grouped_for_training(rows))
