"""Queries over popularity, features, metrics, summaries and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.operators import candidates as cand
from basketline.operators import compare, features, metrics, popularity, prepare, profiling, segments
from basketline.plans import evaluation
from basketline.plans.q_joins import (FEATURES_SQL, LIST28, MONTHS, PAIRED, count_as, list28, monthly_curve, window_scores)
from basketline.plans.q_prepare import CAND_POP, CAND_RECENT, CUSTOMERS, candidates_sql, event_candidates
from basketline.plans.q_sources import META
from basketline.plans.registry import (clean_order_log, CLEAN, METRICS, ORDER_LOG, SCOPED, compare_sql, event_folds, event_folds_sql, final,
                                       order_folds, order_folds_sql, pools_sql, query, recency_sql, scores_sql, with_)
from basketline.sources import logs
from basketline.sources.sinks import version_column

REPLICATES = 200


@query("a1_popularity", final(with_(ORDER_LOG, CLEAN, select="""SELECT article_id, cnt, rank FROM (SELECT article_id, count(*) AS cnt,
  row_number() OVER (ORDER BY count(*) DESC, article_id) AS rank FROM clean GROUP BY article_id) WHERE rank <= 200"""), i="article_id cnt rank"))
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return popularity.top_articles(clean_order_log(spark, sf), 200)


@query("a2_recent_popularity", final(with_(*order_folds_sql((0, 1, 2)), *pools_sql([7, 14, 28, None]),
                                           select='SELECT week, "window", article_id, cnt FROM wc'), i="article_id cnt", d="week", s="window"))
def a2(spark, sf):
    return popularity.window_counts(order_folds(spark, sf, (0, 1, 2)).history, [7, 14, 28, None])


@query("a3_as_of_popularity", final(with_(ORDER_LOG, CLEAN, """sh AS (SELECT max(t_dat) - 10 AS as_of FROM clean)""",
    select="""SELECT article_id, cnt, rank FROM (SELECT article_id, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, article_id) AS rank
  FROM clean, sh WHERE t_dat > as_of - 7 AND t_dat <= as_of GROUP BY article_id) WHERE rank <= 12"""), i="article_id cnt rank"))
def a3(spark, sf):
    log = clean_order_log(spark, sf)
    as_of = log.agg(F.date_sub(F.max("t_dat"), 10)).scalar()
    return popularity.recent_top(log, as_of, 7)


@query("a4_purchase_counts", final(with_(ORDER_LOG, select="""SELECT 'customer' AS side, customer_id AS id, count(*) AS n FROM lg GROUP BY customer_id
  UNION ALL SELECT 'article', article_id, count(*) FROM lg GROUP BY article_id"""), i="id n", s="side"))
def a4(spark, sf):
    log = logs.order_log(spark, sf)
    def side(name: str) -> DataFrame:
        return log.groupBy(F.col(f"{name}_id").alias("id")).agg(count_as("n")).withColumn("side", F.lit(name))
    return side("customer").unionByName(side("article"))


@query("a5_article_sets", final(with_(*event_folds_sql((0, 1)), """sets AS (SELECT 'truth' AS kind, week, customer_id, article_id FROM truth
  UNION ALL SELECT DISTINCT 'owned', week, customer_id, article_id FROM h SEMI JOIN cust USING (week, customer_id)
  UNION ALL SELECT DISTINCT 'recent', week, customer_id, article_id FROM h SEMI JOIN cust USING (week, customer_id)
    JOIN (SELECT week, max(t_dat) AS he FROM h GROUP BY week) USING (week) WHERE t_dat >= he - 6)""",
    select="SELECT kind, week, customer_id, string_agg(article_id, ',' ORDER BY article_id) AS articles FROM sets GROUP BY ALL"),
    i="customer_id", d="week", s="kind articles"))
def a5(spark, sf):
    f = event_folds(spark, sf, (0, 1))
    owned = f.history.select("week", "customer_id", "article_id").distinct().join(f.customers, ["week", "customer_id"], "left_semi")
    recent = cand.recent_purchases(f.history, f.customers, 7)
    rows = [d.withColumn("kind", F.lit(n)) for d, n in ((f.truth, "truth"), (owned, "owned"), (recent, "recent"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("kind", "week", "customer_id").agg(
        F.sort_array(F.collect_set("article_id")).alias("articles"))


@query("a6_distinct_counts", final(with_(ORDER_LOG, select="""SELECT t_dat, count(DISTINCT customer_id) AS n_customers,
  count(DISTINCT article_id) AS n_articles FROM lg GROUP BY t_dat"""), i="n_customers n_articles", d="t_dat"))
def a6(spark, sf):
    return logs.order_log(spark, sf).groupBy("t_dat").agg(
        F.countDistinct("customer_id").alias("n_customers"), F.countDistinct("article_id").alias("n_articles"))


ORDER_ITEM_FEATURES = """itf AS (SELECT article_id, count(*) FILTER (t_dat >= week - 7) AS item_cnt_7d, count(*) AS item_cnt_28d,
  avg(price) AS item_price_mean_28d FROM h WHERE t_dat >= week - 28 GROUP BY article_id)"""


@query("a7_item_features", final(with_(*order_folds_sql(), ORDER_ITEM_FEATURES, select="SELECT * FROM itf"),
                                 i="article_id item_cnt_7d item_cnt_28d", f="item_price_mean_28d"))
def a7(spark, sf):
    f = order_folds(spark, sf)
    return features.item_features(f.history, f.weeks[0])


@query("a8_pair_features", final(with_(*order_folds_sql(), """pf AS (SELECT customer_id, article_id, count(*) AS ci_count,
  any_value(week) - max(t_dat) AS ci_days_since FROM h SEMI JOIN cust USING (customer_id) GROUP BY ALL)""", select="SELECT * FROM pf"),
    i="customer_id article_id ci_count ci_days_since"))
def a8(spark, sf):
    f = order_folds(spark, sf)
    return features.customer_item_features(f.history, f.customers, f.weeks[0]).drop("ci_last")


@query("a9_customer_features", final(with_(*order_folds_sql(), select="""SELECT customer_id, count(*) AS cust_n_purchases,
  any_value(week) - max(t_dat) AS cust_days_since_last FROM h SEMI JOIN cust USING (customer_id) GROUP BY customer_id"""),
    i="customer_id cust_n_purchases cust_days_since_last"))
def a9(spark, sf):
    f = order_folds(spark, sf)
    return features.customer_features(features.customer_item_features(f.history, f.customers, f.weeks[0]))


FEATURE_COLUMNS = "als_score als_rank src_als src_pop src_recent item_cnt_7d item_cnt_28d item_price_mean_28d ci_count ci_days_since cust_n_purchases cust_days_since_last"


def event_features(spark, sf):
    f, rows = event_candidates(spark, sf)
    return f, features.build_features(f.history, rows, f.weeks[0], "ii")


@query("a10_feature_frame", final(with_(*FEATURES_SQL, select="SELECT * REPLACE (CASE WHEN src_als = 1 THEN als_score END AS als_score) FROM ft"),
                                  i="customer_id article_id label", f=FEATURE_COLUMNS, s="source"))
def a10(spark, sf):
    _, rows = event_features(spark, sf)
    return rows.select("customer_id", "article_id", "label", "source", *[F.col(c).cast("double").alias(c) for c in features.FEATURES])


@query("a11_precision_recall", final(with_(*LIST28, *scores_sql("ls", "model", "SELECT 'm' AS model"),
    select='SELECT week, avg(hits / 12) AS "precision", avg(hits / n_true) AS recall FROM sc GROUP BY week'), f="precision recall", d="week"))
def a11(spark, sf):
    f = order_folds(spark, sf, (0, 1))
    scores = metrics.customer_scores(list28(f), f.truth, ["week", "customer_id", "segment"])
    return metrics.metrics(scores, ["week"]).select("week", "precision", "recall")


@query("a12_hit_rate", final(with_(*LIST28, """every AS (SELECT DISTINCT week, customer_id FROM h UNION SELECT week, customer_id FROM cust)""",
    """ht AS (SELECT DISTINCT week, customer_id FROM ls JOIN truth USING (week, customer_id, article_id))""",
    select="""SELECT e.week, count(*) AS n_customers, count(ht.customer_id) / count(*) AS hit_rate FROM every e
  LEFT JOIN ht USING (week, customer_id) GROUP BY e.week"""), i="n_customers", f="hit_rate", d="week"))
def a12(spark, sf):
    """Everyone with history or a target purchase gets a list; customers without truth count as misses."""
    f = order_folds(spark, sf, (0, 1))
    everyone = f.history.select("week", "customer_id").unionByName(f.customers).distinct()
    lists = popularity.same_list_for_all(everyone, popularity.popularity_lists(f.history, [28], 12)).select("week", "customer_id", "items")
    scores = metrics.customer_scores(lists, f.truth, ["week", "customer_id"])
    return metrics.metrics(scores, ["week"]).select("week", "n_customers", "hit_rate")


@query("a13_map", final(with_(*PAIRED, select='SELECT week, model, avg(ap) AS "map" FROM sc GROUP BY ALL'), f="map", d="week", s="model"))
def a13(spark, sf):
    return metrics.metrics(window_scores(order_folds(spark, sf, (0, 1))), ["week", "model"]).select("week", "model", "map")


@query("a14_customer_scores", final(with_(*PAIRED, select="SELECT week, model, customer_id, segment, n_true, hits, ap, hit FROM sc"),
                                    i="customer_id n_true hits", f="ap hit", d="week", s="model segment"))
def a14(spark, sf):
    return window_scores(order_folds(spark, sf, (0, 1)))


@query("a15_one_segment", final(with_(*PAIRED, select=f"""SELECT week, model, {METRICS} FROM sc WHERE segment = '3+ purchases' GROUP BY ALL"""),
                                i="n_customers", f="precision recall hit_rate map", d="week", s="model"))
def a15(spark, sf):
    scores = window_scores(order_folds(spark, sf, (0, 1))).filter(F.col("segment") == segments.SEGMENTS[2])
    return metrics.metrics(scores, ["week", "model"])


@query("a16_metrics_by_scope", final(with_(*PAIRED, SCOPED, select=f"SELECT week, model, scope, {METRICS} FROM sc2 GROUP BY ALL"),
                                     i="n_customers", f="precision recall hit_rate map", d="week", s="model scope"))
def a16(spark, sf):
    return metrics.metrics_by_scope(window_scores(order_folds(spark, sf, (0, 1))), ["week", "model"])


GRID_SQL = [*order_folds_sql((0, 1)), *recency_sql([7, 14, 28, None]), *scores_sql("rl", '"window", exclusion',
            """SELECT "window", exclusion FROM (VALUES ('7d'), ('14d'), ('28d'), ('all-time')) x("window"), (VALUES (true), (false)) y(exclusion)""")]


@query("a17_policy_grid", final(with_(*GRID_SQL, select=f'SELECT week, "window", exclusion, segment, {METRICS} FROM sc GROUP BY ALL'),
                                i="n_customers", f="precision recall hit_rate map", d="week", s="window exclusion segment"))
def a17(spark, sf):
    return evaluation.policy_grid(order_folds(spark, sf, (0, 1)))


RECALL_NS = (5, 10, 20)
RECALL_CONFIG = f"ii+pop{CAND_POP}+recent{CAND_RECENT}d"


def recall_sql() -> list[str]:
    cut = []
    for n in RECALL_NS:
        for name, cond in (("als_only", f"source_rank <= {n}"),
                           (RECALL_CONFIG, f"(source_rank <= {n} OR contains(source, 'pop{CAND_POP}') OR contains(source, 'recent'))")):
            cut.append(f"SELECT '{name}' AS candidates, {n} AS n, week, customer_id, count(*) AS size, sum(label) AS hits FROM cd WHERE {cond} GROUP BY ALL")
    names = ", ".join(f"('{c}', {n})" for n in RECALL_NS for c in ("als_only", RECALL_CONFIG))
    return ["cs AS (" + " UNION ALL ".join(cut) + ")",
            "nt AS (SELECT week, customer_id, count(*) AS n_true FROM truth GROUP BY ALL)",
            f"""rr AS (SELECT c.week, v.candidates, v.n, c.segment, n_true, coalesce(size, 0) AS size, coalesce(hits, 0) AS hits
  FROM cust c CROSS JOIN (VALUES {names}) v(candidates, n) JOIN nt USING (week, customer_id)
  LEFT JOIN cs ON cs.week = c.week AND cs.customer_id = c.customer_id AND cs.candidates = v.candidates AND cs.n = v.n)"""]


@query("a18_candidate_recall", final(with_(*candidates_sql(), *recall_sql(), select="""SELECT week, candidates, n, scope, count(*) AS n_customers,
  sum(hits) / sum(n_true) AS pair_recall, avg(CASE WHEN hits > 0 THEN 1 ELSE 0 END) AS customer_coverage, avg(size) AS mean_candidates
  FROM (SELECT *, unnest(['aggregate', segment]) AS scope FROM rr) GROUP BY ALL"""),
    i="n n_customers", f="pair_recall customer_coverage mean_candidates", d="week", s="candidates scope"))
def a18(spark, sf):
    f, rows = event_candidates(spark, sf)
    return cand.candidate_recall(rows, f.segmented_customers(), f.truth, RECALL_NS, CAND_POP, RECALL_CONFIG)


@query("a19_recent_coverage", final(with_(*order_folds_sql((0, 1, 2)), """rc AS (SELECT DISTINCT week, customer_id, article_id FROM h
  JOIN (SELECT week, max(t_dat) AS he FROM h GROUP BY week) USING (week) SEMI JOIN cust USING (week, customer_id) WHERE t_dat >= he - 27)""",
    select="""SELECT week, 100 * avg(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS pct_any, avg(coalesce(n, 0)) AS mean_items
  FROM cust LEFT JOIN (SELECT week, customer_id, count(*) AS n FROM rc GROUP BY ALL) USING (week, customer_id) GROUP BY week"""),
    f="pct_any mean_items", d="week"))
def a19(spark, sf):
    f = order_folds(spark, sf, (0, 1, 2))
    return cand.recent_coverage(f.customers, cand.recent_purchases(f.history, f.customers, 28))


OVERLAP = """sold AS (SELECT week, article_id, count(*) AS cnt, row_number() OVER (PARTITION BY week ORDER BY count(*) DESC, article_id) AS pos FROM t GROUP BY week, article_id),
ov AS (SELECT p.week, p."window", count(*) FILTER (s.pos <= 12) AS overlap, 100 * coalesce(sum(s.cnt), 0) / any_value(tot) AS coverage_pct
  FROM pool p LEFT JOIN sold s USING (week, article_id) JOIN (SELECT week, count(*) AS tot FROM t GROUP BY week) USING (week)
  WHERE p.rank <= 12 GROUP BY ALL)"""


@query("a20_week_overlap", final(with_(*order_folds_sql((0, 1, 2)), *pools_sql([7, 14, 28, None]), OVERLAP, select="SELECT * FROM ov"),
                                 i="overlap", f="coverage_pct", d="week", s="window"))
def a20(spark, sf):
    f = order_folds(spark, sf, (0, 1, 2))
    return evaluation.week_overlap(f, popularity.popularity_lists(f.history, [7, 14, 28, None], 12))


WEEKS4 = (0, 1, 2, 3)
COLD_MAPS = [*order_folds_sql(WEEKS4), *recency_sql([7, 14, 28, None]), 'ls AS (SELECT *, "window" AS model FROM plain)',
             *scores_sql("ls", "model", "SELECT * FROM (VALUES ('7d'), ('14d'), ('28d'), ('all-time')) x(model)"),
             """bw AS (SELECT * FROM (SELECT week, model AS best, row_number() OVER (PARTITION BY week ORDER BY m DESC, model) AS rn FROM (
  SELECT week, model, round(avg(ap), 12) AS m FROM sc WHERE segment = '0 purchases' GROUP BY ALL)) WHERE rn = 1)"""]


def cold_maps(spark, sf):
    scores = window_scores(order_folds(spark, sf, WEEKS4), (7, 14, 28, None)).filter(F.col("segment") == segments.SEGMENTS[0])
    return metrics.metrics(scores, ["week", "model"]).withColumn("map", F.round("map", 12))


@query("a21_best_window", final(with_(*COLD_MAPS, select="""SELECT b.week, best, won FROM bw b
  JOIN (SELECT best, count(*) AS won FROM bw GROUP BY best) USING (best)"""), i="won", d="week", s="best"))
def a21(spark, sf):
    best = compare.best_per_group(cold_maps(spark, sf), ["week"], "model", "map").withColumnRenamed("model", "best")
    return best.join(best.groupBy("best").agg(count_as("won")), "best")


WEEKLY = [*order_folds_sql((0, 1, 2)), *recency_sql([7, 14, 28]), """ls AS (SELECT week, customer_id, "window" AS model, rank, article_id,
  CASE WHEN exclusion THEN 'exclusion=True' ELSE 'exclusion=False' END AS setting FROM rl)""",
          *scores_sql("ls", "setting, model", """SELECT setting, model FROM (VALUES ('exclusion=True'), ('exclusion=False')) x(setting),
  (VALUES ('7d'), ('14d'), ('28d')) y(model)""")]
WEEKLY_PAIRS = (("14d", "7d"), ("28d", "7d"))


def weekly_scores(spark, sf):
    f = order_folds(spark, sf, (0, 1, 2))
    lists = popularity.recency_lists(f.segmented_customers(), f.history, [7, 14, 28]).select(
        "week", evaluation.setting_label(F.col("exclusion")).alias("setting"), F.col("window").alias("model"), "customer_id", "segment", "items")
    return f, evaluation.score_lists(lists, f.truth)


COMPARED = [*WEEKLY, *compare_sql(WEEKLY_PAIRS, "week, setting", REPLICATES, where="scope IN ('aggregate', '3+ purchases')")]


@query("a22_weekly_comparison", final(with_(*COMPARED, select="""SELECT week, setting, metric, scope, a_model || ' vs ' || b_model AS pair, n,
  rel_diff_pct, sig FROM cmp"""), i="n sig", f="rel_diff_pct", d="week", s="setting metric scope pair"))
def a22(spark, sf):
    rows = evaluation.weekly_comparison(weekly_scores(spark, sf)[1], WEEKLY_PAIRS, REPLICATES)
    return rows.select("week", "setting", "metric", "scope", "pair", "n", "rel_diff_pct", "sig")


CELL = "printf('%+.1f', rel_diff_pct) || CASE WHEN sig <> 0 THEN '*' ELSE '' END"


@query("a23_weekly_summary", final(with_(*COMPARED, "wk AS (SELECT *, (SELECT max(week) FROM fw) - week AS age FROM cmp)",
    select=f"""SELECT setting, metric, scope, a_model || ' vs ' || b_model AS pair, max(CASE WHEN age = 56 THEN {CELL} END) AS oldest,
  max(CASE WHEN age = 28 THEN {CELL} END) AS middle, max(CASE WHEN age = 0 THEN {CELL} END) AS newest, avg(rel_diff_pct) AS mean,
  stddev_samp(rel_diff_pct) AS sd, count(*) FILTER (sig = 1) AS weeks_a_ahead_sig, count(*) FILTER (sig = -1) AS weeks_b_ahead_sig,
  count(*) FILTER (rel_diff_pct > 0) AS weeks_a_ahead_any FROM wk GROUP BY setting, metric, scope, a_model, b_model"""),
    i="weeks_a_ahead_sig weeks_b_ahead_sig weeks_a_ahead_any", f="mean sd", s="setting metric scope pair oldest middle newest"))
def a23(spark, sf):
    f, scores = weekly_scores(spark, sf)
    weekly = evaluation.weekly_comparison(scores, WEEKLY_PAIRS, REPLICATES)
    wide = compare.summarize_weeks(weekly, f.weeks, ["setting", "metric", "scope", "pair"])
    names = {f"wk {w}": n for w, n in zip(sorted(f.weeks), ("oldest", "middle", "newest"))}
    return wide.withColumnsRenamed(names)


@query("a24_pivot_by_scope", final(with_(*WEEKLY, SCOPED, select="""SELECT week, setting, model, avg(ap) FILTER (scope = 'aggregate') AS "aggregate",
  avg(ap) FILTER (scope = '0 purchases') AS s0, avg(ap) FILTER (scope = '1-2 purchases') AS s12,
  avg(ap) FILTER (scope = '3+ purchases') AS s3 FROM sc2 GROUP BY ALL"""), f="aggregate s0 s12 s3", d="week", s="setting model"))
def a24(spark, sf):
    rows = metrics.metrics_by_scope(weekly_scores(spark, sf)[1], ["week", "setting", "model"])
    wide = rows.groupBy("week", "setting", "model").pivot("scope", list(segments.SCOPES)).agg(F.first("map"))
    return wide.withColumnsRenamed(dict(zip(segments.SEGMENTS, ("s0", "s12", "s3"))))


# the sweep tables over the windows as configs: 7d stands in for the frozen one
SWEPT = [*WEEKLY, *compare_sql(WEEKLY_PAIRS, "week, setting", REPLICATES, where="scope = 'aggregate'"),
         """sw AS (SELECT a.week, a.a_model AS config, a.setting, a.mean_a AS "map", a.rel_diff_pct AS rel_map_pct, a.sig, h2.mean_a AS hit,
  h2.rel_diff_pct AS rel_hit_pct FROM cmp a JOIN cmp h2 USING (week, setting, a_model, b_model) WHERE a.metric = 'ap' AND h2.metric = 'hit')"""]


def sweep_rows(spark, sf):
    f, scores = weekly_scores(spark, sf)
    rows = compare.compare_models(scores, WEEKLY_PAIRS, ["week", "setting"], REPLICATES, scopes=(segments.AGGREGATE,))
    return f, compare.sweep_table(rows, "7d")


@query("a25_sweep_table", final(with_(*SWEPT, select="SELECT * FROM sw"), i="sig", f="map hit rel_map_pct rel_hit_pct", d="week", s="config setting"))
def a25(spark, sf):
    return sweep_rows(spark, sf)[1]


@query("a26_candidate_rule", final(with_(*SWEPT, """ps AS (SELECT config, setting, count(DISTINCT week) AS weeks, avg(rel_map_pct) AS mean_rel,
  count(*) FILTER (sig = -1) AS worse FROM sw GROUP BY ALL)""", select="""SELECT config, bool_and(weeks = 3 AND mean_rel >= 3 AND worse = 0) AND count(*) = 2
  AS candidate, min(mean_rel) AS min_mean_rel, sum(worse) AS weeks_worse FROM ps GROUP BY config"""),
    i="weeks_worse", f="min_mean_rel", s="config candidate"))
def a26(spark, sf):
    f, rows = sweep_rows(spark, sf)
    return compare.candidate_configs(rows, f.weeks)


@query("a27_best_config", final(with_(*WEEKLY, select="""SELECT model AS config, round(avg(ap), 12) AS "map" FROM sc WHERE setting = 'exclusion=True'
  GROUP BY model ORDER BY "map" DESC, config LIMIT 1"""), f="map", s="config"))
def a27(spark, sf):
    scores = weekly_scores(spark, sf)[1].filter(F.col("setting") == "exclusion=True")
    rows = metrics.metrics(scores, ["model"]).select(F.col("model").alias("config"), F.round("map", 12).alias("map"))
    return compare.best_config(rows)


COUNTS = """cc AS (SELECT c_custkey, coalesce(n, 0) AS cnt FROM customer LEFT JOIN (SELECT customer_id, count(*) AS n FROM h GROUP BY ALL) ON customer_id = c_custkey),
ac AS (SELECT p_partkey, coalesce(n, 0) AS cnt FROM part LEFT JOIN (SELECT article_id, count(*) AS n FROM h GROUP BY ALL) ON article_id = p_partkey)"""


@query("a28_profile_ratios", final(with_(*order_folds_sql(), COUNTS, select="""SELECT * FROM (SELECT 100 * avg((cnt < 3)::INT) AS cold_start_pct,
  100 * avg((cnt > 1)::INT) AS repeat_pct FROM cc), (SELECT count(*) FILTER (cnt <= 1) AS articles_0_1, 100 * avg((cnt <= 1)::INT) AS articles_0_1_pct FROM ac)"""),
    i="articles_0_1", f="cold_start_pct repeat_pct articles_0_1_pct"))
def a28(spark, sf):
    log = order_folds(spark, sf).history
    return profiling.profile_ratios(profiling.counts_with_zero(logs.customers(spark, sf), log, "customer_id"),
                                    profiling.counts_with_zero(logs.articles(spark, sf), log, "article_id"))


@query("a29_category_shares", final(with_(ORDER_LOG, select="""SELECT p_brand AS product_group_name, count(*) AS n,
  100 * count(*) / sum(count(*)) OVER () AS share_pct FROM lg LEFT JOIN part ON p_partkey = article_id GROUP BY ALL"""),
    i="n", f="share_pct", s="product_group_name"))
def a29(spark, sf):
    return profiling.category_counts(logs.order_log(spark, sf), logs.articles(spark, sf), "product_group_name")


@query("a29_value_counts", final(with_(CUSTOMERS, select="""SELECT 'FN' AS flag, CAST(fn AS DOUBLE) AS value, count(*) AS n FROM cu GROUP BY ALL
  UNION ALL SELECT 'Active', CAST(act AS DOUBLE), count(*) FROM cu GROUP BY ALL"""), i="n", f="value", s="flag"))
def a29_values(spark, sf):
    people = logs.customers(spark, sf)
    parts = [profiling.value_counts(people, c).select(F.lit(c).alias("flag"), F.col(c).alias("value"), "n") for c in ("FN", "Active")]
    return parts[0].unionByName(parts[1])


@query("a30_histogram", final(with_(*order_folds_sql(), COUNTS, select="""SELECT least(CAST(floor(CAST(cnt - lo AS DOUBLE) * 50 / (hi - lo)) AS INT) + 1, 50) AS bin,
  count(*) AS n FROM cc, (SELECT min(cnt) AS lo, max(cnt) AS hi FROM cc) GROUP BY ALL"""), i="bin n"))
def a30(spark, sf):
    counts = profiling.counts_with_zero(logs.customers(spark, sf), order_folds(spark, sf).history, "customer_id")
    return profiling.histogram(counts, "cnt")


def describe_sql() -> str:
    parts = []
    for c in features.FEATURES:
        x = "CASE WHEN src_als = 1 THEN als_score END" if c == "als_score" else c
        parts.append(f"SELECT '{c}' AS feature, count({x}) AS \"count\", avg({x}) AS mean, min({x}) AS \"min\", max({x}) AS \"max\" FROM ft")
    return " UNION ALL ".join(parts)


@query("a31_describe_features", final(with_(*FEATURES_SQL, select=describe_sql()), i="count", f="mean min max", s="feature"))
def a31(spark, sf):
    return features.describe(event_features(spark, sf)[1])


@query("a31_means_by_label", final(with_(*FEATURES_SQL, select="SELECT label, " + ", ".join(
    f"avg({'CASE WHEN src_als = 1 THEN als_score END' if c == 'als_score' else c}) AS {c}" for c in features.FEATURES) + " FROM ft GROUP BY label"),
    i="label", f=FEATURE_COLUMNS))
def a31_labels(spark, sf):
    return features.means_by_label(event_features(spark, sf)[1])


@query("a31_describe_counts", final(with_(*order_folds_sql(), COUNTS, select="""SELECT count(cnt) AS "count", avg(cnt) AS mean, stddev_samp(cnt) AS std,
  min(cnt) AS "min", quantile_cont(cnt::DOUBLE, 0.25) AS p25, quantile_cont(cnt::DOUBLE, 0.5) AS p50, quantile_cont(cnt::DOUBLE, 0.75) AS p75, max(cnt) AS "max" FROM cc"""),
    i="count min max", f="mean std p25 p50 p75"))
def a31_counts(spark, sf):
    counts = profiling.counts_with_zero(logs.customers(spark, sf), order_folds(spark, sf).history, "customer_id")
    return profiling.describe_value(counts, "cnt")


ARTICLE_COLUMNS = {"product_code": "p_partkey // 1000", "prod_name": "p_name", "product_group_name": "p_brand",
                   "department_name": "p_type", "section_no": "p_size"}


@query("a32_cardinalities", final(" UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(DISTINCT {x}) AS n_distinct FROM part" for n, x in ARTICLE_COLUMNS.items()), i="n_distinct", s="column_name"))
def a32(spark, sf):
    return profiling.cardinalities(logs.articles(spark, sf), list(ARTICLE_COLUMNS))


def nearest_rank(p: int) -> str:
    return f"round(list_sort(list(value))[greatest(({p} * count(*) + 99) // 100, 1)], 3) AS p{p}"


@query("a33_latency_summary", final(f"""SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean, {nearest_rank(50)}, {nearest_rank(90)},
  {nearest_rank(95)}, {nearest_rank(99)}, round(max(value), 3) AS "max" FROM events GROUP BY event_type""",
    i="n", f="mean p50 p90 p95 p99 max", s="event_type"))
def a33(spark, sf):
    return profiling.latency_summary(logs.table(spark, sf, "events"), "value", ["event_type"])


@query("a33_upper_median", final("""SELECT event_type, v[len(v) // 2 + 1] AS p50 FROM (SELECT event_type, list_sort(list(p50)) AS v FROM (
  SELECT event_type, CAST(ts AS DATE) AS d, round(list_sort(list(value))[greatest((50 * count(*) + 99) // 100, 1)], 3) AS p50
  FROM events GROUP BY ALL) GROUP BY ALL)""", f="p50", s="event_type"))
def a33_runs(spark, sf):
    """The middle day's median per event type, a day being one run."""
    log = logs.table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    return profiling.upper_median(profiling.latency_summary(log, "value", ["event_type", "d"]), "p50", ["event_type"])


@query("a34_loss_reading", final(with_(ORDER_LOG, MONTHS, select="""SELECT "first", "last", "at", 100 * ("first" - "at") / nullif("first" - "last", 0) AS share_pct,
  100 * ("at" - "last") / nullif("at", 0) AS remaining_pct FROM (SELECT min_by(loss, iteration) AS "first", max_by(loss, iteration) AS "last",
  max(CASE WHEN iteration = 20 THEN loss END) AS "at" FROM mo)"""), f="first last at share_pct remaining_pct"))
def a34(spark, sf):
    return profiling.loss_reading(monthly_curve(spark, sf), 20)


@query("a35_model_version", final(with_(*event_folds_sql((0, 1, 2)), select="""SELECT week, 'als-f150-r0.1-a15-i40-h' || max(t_dat) AS model_version FROM h GROUP BY week"""),
                                  d="week", s="model_version"))
def a35(spark, sf):
    ends = event_folds(spark, sf, (0, 1, 2)).history.groupBy("week").agg(F.max("t_dat").cast("string").alias("history_end"))
    meta = ends.withColumns({name: F.lit(value) for name, value in META.items()})
    return meta.select("week", version_column(meta).alias("model_version"))
