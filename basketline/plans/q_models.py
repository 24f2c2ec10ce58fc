"""Queries over the models: item-item, ALS, factor scoring, ranking, comparison and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketline.functions.lists import to_rows
from basketline.operators import als as als_ops
from basketline.operators import compare, factors, features, metrics, popularity, prepare, profiling, ranker, segments
from basketline.operators.candidates import candidate_recall
from basketline.operators.folds import build_folds, last_day
from basketline.operators.itemitem import ItemItem, catalogue, interactions, weighted_interactions, with_fallback
from basketline.plans import evaluation, reranking
from basketline.plans.q_aggregates import OVERLAP, REPLICATES, WEEKS4, event_features, weekly_scores
from basketline.plans.q_aggregates import WEEKLY as WEEKLY_SQL
from basketline.plans.q_joins import DOTS, FEATURES_SQL, PAIRED, scored_rows, vectors, window_scores
from basketline.plans.q_prepare import CAND_N, CAND_POP, CAND_RECENT, event_candidates
from basketline.plans.q_sources import SMALL_ALS
from basketline.plans.registry import (clean_event_log, CLEAN, EVENT_LOG, METRICS, SCOPED, SETTING, bootstrap_sql, compare_sql, event_folds, event_folds_sql,
                                       final, item_item_sql, order_folds, order_folds_sql, pools_sql, query, recency_sql, scores_sql,
                                       two_models_sql, with_)
from basketline.session import materialize, scratch_path
from basketline.sources import logs
from basketline.sources.score_store import ScoreStore

TOP_N = 200  # catalogue cut of the matrix queries on the order log


@query("m1_binary_interactions", final(with_(*event_folds_sql(), *item_item_sql(), select="SELECT customer_id, article_id, col FROM pairs"),
                                       i="customer_id article_id col"))
def m1(spark: SparkSession, sf: str) -> DataFrame:
    history = event_folds(spark, sf).history
    return interactions(history, catalogue(history))


@query("m1_top_items_only", final(with_(*order_folds_sql(), f"""top AS (SELECT article_id FROM h GROUP BY article_id
  ORDER BY count(*) DESC, article_id LIMIT {TOP_N})""", select="SELECT DISTINCT customer_id, article_id FROM h SEMI JOIN top USING (article_id)"),
    i="customer_id article_id"))
def m1_top(spark, sf):
    history = order_folds(spark, sf).history
    return interactions(history, catalogue(history, TOP_N)).drop("col")


@query("m2_weighted_interactions", final(with_(*event_folds_sql(), select="SELECT customer_id, article_id, count(*) AS weight FROM h GROUP BY ALL"),
                                         i="customer_id article_id weight"))
def m2(spark, sf):
    return weighted_interactions(event_folds(spark, sf).history)


@query("m3_item_similarity", final(with_(*event_folds_sql(), *item_item_sql(), select="""SELECT x.article_id AS item_a, y.article_id AS item_b, sim.sim AS sim
  FROM sim JOIN items x ON x.col = a JOIN items y ON y.col = b"""), i="item_a item_b", f="sim"))
def m3(spark, sf):
    return ItemItem(event_folds(spark, sf).history).similarity_by_article()


@query("m3_similarity_wide_catalogue", final(with_(*order_folds_sql(), *item_item_sql(), select="""SELECT a, count(*) AS n_neighbours,
  sum(sim) AS total, max(CASE WHEN a <> b THEN sim END) AS closest FROM sim GROUP BY a"""), i="a n_neighbours", f="total closest"))
def m3_wide(spark, sf):
    """Per article over the whole order-log catalogue: neighbours, total and closest similarity."""
    return ItemItem(order_folds(spark, sf).history).neighbour_counts()


@query("m4_item_item_lists", final(with_(*event_folds_sql(), *item_item_sql(), select="SELECT exclusion, customer_id, rank, article_id FROM iil"),
                                   i="customer_id rank article_id", s="exclusion"))
def m4(spark, sf):
    f = event_folds(spark, sf)
    return to_rows(ItemItem(f.history).recommend(f.customers))


@query("m4_item_item_lists_order_log", final(with_(*order_folds_sql(), *item_item_sql(), select="SELECT exclusion, customer_id, rank, article_id FROM iil"),
                                             i="customer_id rank article_id", s="exclusion"))
def m4_orders(spark, sf):
    f = order_folds(spark, sf)
    return to_rows(ItemItem(f.history).recommend(f.customers))


SWAPPED = """sw AS (SELECT 'recent' AS variant, customer_id, rank, article_id FROM iil WHERE exclusion
  UNION ALL SELECT 'alltime', customer_id, rank, article_id FROM iil WHERE exclusion
  UNION ALL SELECT CASE p."window" WHEN '7d' THEN 'recent' ELSE 'alltime' END, c.customer_id, p.rank, p.article_id
  FROM cust c ANTI JOIN known USING (customer_id) JOIN pool p ON p.week = c.week AND p.rank <= 12)"""


@query("m5_swap_fallback", final(with_(*order_folds_sql(), *pools_sql([7, None]), *item_item_sql(), SWAPPED, select="SELECT * FROM sw"),
                                 i="customer_id rank article_id", s="variant"))
def m5(spark, sf):
    """One scoring, two fallback lists."""
    f = order_folds(spark, sf)
    personal = materialize(ItemItem(f.history).recommend(f.customers, settings=(True,)).select("customer_id", "items"))
    pools = popularity.popularity_lists(f.history, [7, None], 12)
    out = None
    for label, variant in (("7d", "recent"), ("all-time", "alltime")):
        part = with_fallback(personal, f.customers, pools.filter(F.col("window") == label).select("week", "items"))
        part = to_rows(part.select(F.lit(variant).alias("variant"), "customer_id", "items"))
        out = part if out is None else out.unionByName(part)
    return out


def event_als(spark, sf, offsets=(0,)):
    f = event_folds(spark, sf, offsets)
    return f, als_ops.fit_als(als_ops.index_interactions(f.history), SMALL_ALS)


@query("m6_als_fit", final(with_(*event_folds_sql(), select=f"""SELECT 'customer' AS side, customer_id AS id, {SMALL_ALS['factors']} AS n_factors,
  true AS finite FROM h GROUP BY customer_id UNION ALL SELECT 'article', article_id, {SMALL_ALS['factors']}, true FROM h GROUP BY article_id"""),
    i="id n_factors", s="side finite"))
def m6(spark, sf):
    """Factor rows of both sides: their ids and sizes, and whether all numbers are finite."""
    _, fitted = event_als(spark, sf)
    def side(name: str, rows: DataFrame, key: str) -> DataFrame:
        finite = F.forall("features", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.select(F.lit(name).alias("side"), F.col(key).alias("id"), F.size("features").alias("n_factors"), finite.alias("finite"))
    return side("customer", fitted.user_factors, "customer_id").unionByName(side("article", fitted.item_factors, "article_id"))


KNOWN_SQL = """kn AS (SELECT customer_id, count(DISTINCT article_id) AS n_own, (SELECT count(DISTINCT article_id) FROM h) AS n_all
  FROM h SEMI JOIN cust USING (customer_id) GROUP BY customer_id)"""


@query("m7_als_lists", final(with_(*event_folds_sql(), KNOWN_SQL, select="""SELECT mode, customer_id,
  CASE mode WHEN 'discover' THEN least(12, n_all - n_own) ELSE least(12, n_all) END AS n, 0 AS repeats, 0 AS owned_in_discover
  FROM kn, (VALUES ('repurchase'), ('discover')) m(mode)"""), i="customer_id n repeats owned_in_discover", s="mode"))
def m7(spark, sf):
    """Both lists of every customer with factors: how long, repeated articles, and owned ones where none may be."""
    f, fitted = event_als(spark, sf)
    lists = als_ops.recommend(fitted, f.customers, f.history)
    own = f.history.groupBy("customer_id").agg(F.collect_set("article_id").alias("own"))
    held = F.when(F.col("mode") == "discover", F.size(F.array_intersect("items", "own"))).otherwise(0)
    return lists.join(own, "customer_id").select("mode", "customer_id", F.size("items").alias("n"), (F.size("items") - F.size(
        F.array_distinct("items"))).alias("repeats"), held.alias("owned_in_discover"))


@query("m8_als_top_n", final(with_(*event_folds_sql(), KNOWN_SQL, select=f"""SELECT customer_id, least({CAND_N}, n_all) AS n,
  least({CAND_N}, n_all) AS last_rank, 0 AS out_of_order FROM kn"""), i="customer_id n last_rank out_of_order"))
def m8(spark, sf):
    """The n best articles of every customer with factors: how many, their last rank, and ranks against the order of scores."""
    f, fitted = event_als(spark, sf)
    rows = als_ops.top_n(fitted, f.customers, CAND_N)
    before = F.lag("score").over(Window.partitionBy("customer_id").orderBy("rank"))
    return rows.withColumn("up", F.col("score") > before).groupBy("customer_id").agg(
        F.countDistinct("article_id").alias("n"), F.max("rank").alias("last_rank"), F.count_if("up").alias("out_of_order"))


@query("m9_factor_scoring", final(with_(DOTS, select="""SELECT user_id, mode, rank, item_id, round(score * 1e9) AS score FROM (SELECT *, row_number() OVER
  (PARTITION BY mode, user_id ORDER BY score DESC, item_id) AS rank FROM dt, (VALUES ('repurchase'), ('discover')) m(mode)
  WHERE NOT (mode = 'discover' AND user_id = item_id)) WHERE rank <= 12"""), i="user_id rank item_id score", s="mode"))
def m9(spark, sf):
    """Both modes from one product; a vector owns itself."""
    users = vectors(spark, sf, "user_id")
    owned = users.select("user_id", F.col("user_id").alias("item_id"))
    return scored_rows(factors.score_top_k(users, vectors(spark, sf, "item_id"), 12, owned, factors.MODES))


@query("m9_rescore_from_factors", final(with_(*event_folds_sql(), KNOWN_SQL, select="""SELECT mode, count(*) AS n_customers, true AS in_range
  FROM kn, (VALUES ('repurchase'), ('discover')) m(mode) GROUP BY mode"""), i="n_customers", s="mode in_range"))
def m9_rescore(spark, sf):
    """A week scored from the factors alone: customers by mode, and whether MAP and hit rate are possible values."""
    f, fitted = event_als(spark, sf)
    lists = als_ops.recommend(fitted, f.customers, f.history).withColumn("week", F.lit(f.weeks[0]))
    scores = metrics.customer_scores(lists.select("week", "customer_id", "mode", "items"), f.truth, ["week", "mode", "customer_id"])
    return metrics.metrics(scores, ["mode"]).select("mode", "n_customers", (F.col("map").between(0, F.col("hit_rate")) & (F.col("hit_rate") <= 1)).alias("in_range"))


@query("m10_training_loss", final("""SELECT unnest([1, 2, 4, 8]) AS iteration, unnest([true, true, true, true]) AS falls,
  unnest([0.0, 0.0, 0.0, 0.0]) AS off""", i="iteration", f="off", s="falls"))
def m10(spark, sf):
    """One fit that stops after 1, 2, 4 and 8 sweeps and goes on: whether the loss fell, and by how much what the
    fit reports is off the objective computed from the factors it has written."""
    data = als_ops.index_interactions(event_folds(spark, sf).history)
    fitted, rows, before = None, None, float("inf")
    for n, more in ((1, 1), (2, 1), (4, 2), (8, 4)):
        fitted = als_ops.fit_als(data, {**SMALL_ALS, "iterations": more}, start=fitted)
        reported = fitted.losses[-1][1]
        row = als_ops.direct_loss(fitted).select(
            F.lit(n).alias("iteration"), F.lit(0 < reported < before).alias("falls"), (F.abs(F.col("loss") - F.lit(reported)) / F.col("loss")).alias("off"))
        rows, before = row if rows is None else rows.unionByName(row), reported
    return rows


@query("m11_sweep")
def m11(spark, sf):
    """Two variants against a frozen config over two weeks, both settings."""
    log = clean_event_log(spark, sf)
    end = last_day(log)
    weeks = event_folds(spark, sf, (0, 1)).weeks
    frozen = {**SMALL_ALS, "iterations": 3}
    grid = {"frozen": frozen, "alpha40": {**frozen, "alpha": 40.0}, "f4": {**frozen, "factors": 4}}
    store = ScoreStore(spark, scratch_path(spark, f"sweep-{end}"))
    scores = evaluation.sweep(log, weeks, store, grid).select(
        "week", "setting", "model", "customer_id", "segment", "ap", "hit")
    rows = compare.compare_models(scores, [(c, "frozen") for c in grid if c != "frozen"], ["week", "setting"], REPLICATES,
                                  scopes=(segments.AGGREGATE,))
    return compare.sweep_table(rows)


@query("m12_candidate_generation")
def m12(spark, sf):
    """ALS candidates with recall per scope."""
    f = event_folds(spark, sf)
    personal = reranking.als_personal(f, CAND_N, SMALL_ALS)
    rows = reranking.labelled_candidates(f, personal, CAND_N, CAND_POP, CAND_RECENT)
    config = f"als+pop{CAND_POP}+recent{CAND_RECENT}d"
    return candidate_recall(rows, f.segmented_customers(), f.truth, (5, 10, 20), CAND_POP, config)


RANKER = {"rounds": 6, "learning_rate": 0.2, "leaves": 15, "min_rows": 10, "truncation": 12}


def ranked_week(spark, sf, discover=False):
    """Train on the week before, score the last week."""
    train, test = event_folds(spark, sf, (1,)), event_folds(spark, sf)
    frames = []
    for f in (train, test):
        rows = reranking.labelled_candidates(f, reranking.item_item_personal(f, CAND_N), CAND_N, CAND_POP, CAND_RECENT, "ii")
        frames.append(materialize(reranking.features_of(f, rows, "ii")))
    learned = ranker.discover_only(frames[0]) if discover else frames[0]
    return test, frames[1], ranker.train_ranker(learned, **RANKER)


@query("m13_lambdarank")
def m13(spark, sf):
    f, rows, fitted = ranked_week(spark, sf)
    lists = reranking.ranked_models(f, rows, fitted)
    return metrics.metrics_by_scope(reranking.scored_models(f, lists), ["model"])


@query("m14_ranker_importance", final(with_(*[f"ft AS (SELECT unnest({list(features.FEATURES)}) AS feature)"], select="""SELECT feature, true AS in_range,
  1 AS total_share, true AS tells_rows_apart FROM ft"""), f="total_share", s="feature in_range tells_rows_apart"))
def m14(spark, sf):
    """Each feature's share of the gain lies between 0 and 1, all add up to 1, and the scores differ."""
    _, rows, fitted = ranked_week(spark, sf)
    differ = fitted.score(rows).agg((F.countDistinct("score") > 1).alias("tells_rows_apart"))
    known = fitted.importances()
    shares = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(0 <= v <= 1).alias("in_range"),
                                F.lit(sum(share for _, share in known)).alias("total_share")) for c, v in known])
    return differ.select("tells_rows_apart", F.inline(shares))


@query("b3_ranker_gaps_discover")
def b3_ranker(spark, sf):
    """Never-bought candidates only: the ranker against its baselines, with intervals."""
    f, rows, fitted = ranked_week(spark, sf, discover=True)
    return reranking.ranking_report(f, rows, fitted, discover=True, replicates=REPLICATES)[1]


RULE = """ru AS (SELECT *, CASE WHEN ci_days_since <= 28 THEN 1e9 - ci_days_since ELSE item_cnt_7d END AS rule FROM ft)"""


@query("m15_repurchase_rule", final(with_(*FEATURES_SQL, RULE, select="""SELECT customer_id, rank, article_id FROM (SELECT *, row_number() OVER
  (PARTITION BY customer_id ORDER BY rule DESC, source_rank ASC NULLS LAST, article_id) AS rank FROM ru) WHERE rank <= 12"""),
    i="customer_id rank article_id"))
def m15(spark, sf):
    return to_rows(ranker.repurchase_popularity(event_features(spark, sf)[1])).drop("week")


ROUTED = """own AS (SELECT * FROM (SELECT week, customer_id, article_id, row_number() OVER (PARTITION BY week, customer_id
  ORDER BY count(*) DESC, article_id) AS rank FROM h SEMI JOIN cust USING (week, customer_id) GROUP BY week, customer_id, article_id) WHERE rank <= 12)"""


@query("m16_cold_routing", final(with_(*order_folds_sql((0, 1)), *pools_sql([7]), ROUTED, select="""SELECT c.week, c.customer_id, c.segment,
  coalesce(CASE WHEN c.n_purchases = 0 THEN p.items ELSE o.items END, '') AS items FROM cust c
  LEFT JOIN (SELECT week, customer_id, string_agg(article_id, ',' ORDER BY rank) AS items FROM own GROUP BY ALL) o USING (week, customer_id)
  JOIN (SELECT week, string_agg(article_id, ',' ORDER BY rank) AS items FROM pool WHERE rank <= 12 GROUP BY week) p USING (week)"""),
    i="customer_id", d="week", s="segment items"))
def m16(spark, sf):
    """Customers without history get the 7-day list, everyone else their own most bought articles."""
    f = order_folds(spark, sf, (0, 1))
    people = f.segmented_customers().select("week", "customer_id", "segment")
    counts = popularity.article_counts(f.history.join(f.customers, ["week", "customer_id"], "left_semi"), ["week", "customer_id"])
    own = popularity.to_lists(popularity.top_k(counts, ["week", "customer_id"], popularity.count_order(), 12), ["week", "customer_id"])
    popular = popularity.same_list_for_all(people, popularity.popularity_lists(f.history, [7], 12))
    return ranker.route_cold(own, popular, people)


@query("m17_personal_baseline", final(with_(*FEATURES_SQL, """al AS (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id
  ORDER BY als_rank, article_id) AS rank FROM ft WHERE src_als = 1)""", """cl AS (SELECT customer_id, article_id, row_number() OVER
  (PARTITION BY customer_id ORDER BY source_rank, article_id) AS rank FROM ft WHERE src_als = 0 AND starts_with(source, 'pop') AND source_rank IS NOT NULL)""",
    select="""SELECT customer_id, rank, article_id FROM al WHERE rank <= 12 UNION ALL SELECT customer_id, rank, article_id FROM cl
  ANTI JOIN al USING (customer_id) WHERE rank <= 12"""), i="customer_id rank article_id"))
def m17(spark, sf):
    return to_rows(ranker.personal_baseline(event_features(spark, sf)[1])).drop("week")


@query("m18_two_models", final(with_(*two_models_sql(), SCOPED, select=f"SELECT setting, model, scope, {METRICS} FROM sc2 GROUP BY ALL"),
                               i="n_customers", f="precision recall hit_rate map", s="setting model scope"))
def m18_two(spark, sf):
    """Item-item and the 14-day list under both settings, matched 7-day fallback."""
    f = event_folds(spark, sf)
    lists = evaluation.item_item_model(f).unionByName(evaluation.recency_models(f))
    return metrics.metrics_by_scope(evaluation.score_lists(lists, f.truth), ["setting", "model"])


@query("m18_three_models", final(with_(*two_models_sql(), SCOPED, select=f"""SELECT setting, model, scope, {METRICS} FROM sc2 GROUP BY ALL
  UNION ALL SELECT setting, 'ALS', scope, count(*), NULL, NULL, NULL, NULL FROM sc2 WHERE model = 'item-item CF' GROUP BY ALL"""),
    i="n_customers", f="precision recall hit_rate map", s="setting model scope"))
def m18(spark, sf):
    """Item-item and the 14-day list with their metrics, ALS (whose factors SQL does not know) with its customers."""
    f = event_folds(spark, sf)
    scores = evaluation.three_models(f, SMALL_ALS)
    rows = metrics.metrics_by_scope(scores, ["setting", "model"])
    return rows.withColumns({c: F.when(F.col("model") != evaluation.ALS_MODEL, F.col(c)) for c in ("precision", "recall", "hit_rate", "map")})


@query("m18_rolling_backtest")
def m18_backtest(spark, sf):
    """Three models over two weekly folds: stored scores, paired intervals, one row per comparison."""
    log = clean_event_log(spark, sf)
    weeks = event_folds(spark, sf, (0, 1)).weeks
    store = ScoreStore(spark, scratch_path(spark, "backtest"))
    scores = evaluation.backtest(log, weeks, store, SMALL_ALS)
    weekly = evaluation.weekly_comparison(scores, replicates=REPLICATES)
    wide = compare.summarize_weeks(weekly, weeks, ["setting", "metric", "scope", "pair"])
    return wide.withColumnsRenamed({f"wk {w}": n for w, n in zip(weeks, ("newest", "older"))})


@query("m19_recency_recheck", final(with_(*WEEKLY_SQL, select="""SELECT week, setting, model, avg(ap) AS "map", avg(hit) AS hit_rate FROM sc
  WHERE model IN ('7d', '14d') GROUP BY ALL"""), f="map hit_rate", d="week", s="setting model"))
def m19(spark, sf):
    scores = weekly_scores(spark, sf)[1].filter(F.col("model").isin("7d", "14d"))
    return metrics.metrics(scores, ["week", "setting", "model"]).select("week", "setting", "model", "map", "hit_rate")


DIAGNOSED = [*order_folds_sql(WEEKS4), *recency_sql([7, 14, 28, None]), 'ls AS (SELECT *, "window" AS model FROM plain)',
             *scores_sql("ls", "model", "SELECT * FROM (VALUES ('7d'), ('14d'), ('28d'), ('all-time')) x(model)"),
             *compare_sql([(m, "7d") for m in ("14d", "28d", "all-time")], "week", REPLICATES, metrics=("ap",), where="scope = '0 purchases'"), OVERLAP]


@query("m20_fallback_diagnostic", final(with_(*DIAGNOSED, """po AS (SELECT week, model AS "window", count(*) FILTER (segment = '0 purchases') AS n_seg0,
  avg(ap) FILTER (segment = '0 purchases') AS seg0_map, avg(hit) FILTER (segment = '0 purchases') AS seg0_hit, avg(ap) AS all_map, avg(hit) AS all_hit
  FROM sc GROUP BY ALL)""", select="""SELECT po.*, overlap, coverage_pct, CASE WHEN po."window" = '7d' THEN '' WHEN verdict = 'identical' THEN 'identical'
  ELSE printf('%+.1f%%', rel_diff_pct) || CASE WHEN sig <> 0 THEN '*' ELSE '' END END AS seg0_vs_7d FROM po
  LEFT JOIN cmp ON cmp.week = po.week AND cmp.a_model = po."window" JOIN ov ON ov.week = po.week AND ov."window" = po."window" """),
    i="n_seg0 overlap", f="seg0_map seg0_hit all_map all_hit coverage_pct", d="week", s="window seg0_vs_7d"))
def m20(spark, sf):
    return evaluation.diagnose_fallback(order_folds(spark, sf, WEEKS4), replicates=REPLICATES)


@query("m21_exclusion_table", final(with_(EVENT_LOG, CLEAN, """sp AS (SELECT *, t_dat < (SELECT max(t_dat) FROM clean) - 6 AS seen FROM clean)""",
    select="SELECT DISTINCT sha256(CAST(customer_id AS VARCHAR)) AS customer_id, article_id FROM sp WHERE seen"), i="article_id", s="customer_id"))
def m21(spark, sf):
    history = event_folds(spark, sf).history
    return history.select("customer_id", "article_id").distinct().withColumn("customer_id", logs.hashed_id("customer_id"))


DIFFS = [*PAIRED, """dd AS (SELECT a.week, a.customer_id, a.segment, a.ap - b.ap AS d FROM sc a JOIN sc b USING (week, customer_id)
  WHERE a.model = '14d' AND b.model = '7d')"""]
PAIR = [("14d", "7d")]


@query("b1_bootstrap", final(with_(*DIFFS, *bootstrap_sql(REPLICATES), select="""SELECT week, scope, replicate, sum(w * d) / sum(w) AS mean
  FROM (SELECT *, unnest(['aggregate', segment]) AS scope FROM dd) JOIN wt USING (customer_id) WHERE w > 0 GROUP BY ALL"""),
    i="replicate", f="mean", d="week", s="scope"))
def b1(spark, sf):
    rows = compare.pair_differences(window_scores(order_folds(spark, sf, (0, 1))), PAIR, ["week"], ("ap",))
    return compare.poisson_bootstrap(rows, ["week"], {"mean": F.col("d")}, REPLICATES)


@query("b1_bootstrap_resample", final(with_(*DIFFS, """ix AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY customer_id) - 1 AS slot,
  count(*) OVER (PARTITION BY week) AS n FROM dd)""", f"""dr AS (SELECT week, replicate,
  CAST('0x' || substr(md5('42|' || replicate || '|' || slot), 1, 8) AS BIGINT) % n AS slot FROM ix, range(0, {REPLICATES}) r(replicate))""",
    select="SELECT week, replicate, avg(d) AS mean FROM dr JOIN ix USING (week, slot) GROUP BY ALL"), i="replicate", f="mean", d="week"))
def b1_resample(spark, sf):
    rows = compare.pair_differences(window_scores(order_folds(spark, sf, (0, 1))), PAIR, ["week"], ("ap",))
    return compare.resample_bootstrap(rows, ["week"], REPLICATES)


B2_SQL = [*WEEKLY_SQL, *compare_sql([("14d", "7d"), ("28d", "7d"), ("28d", "14d")], "week, setting", REPLICATES)]


@query("b2_intervals", final(with_(*B2_SQL, select="SELECT * FROM cmp"), i="n sig", f="mean_a mean_b diff ci_low ci_high rel_diff_pct", d="week",
                             s="setting a_model b_model metric scope verdict"))
def b2(spark, sf):
    pairs = [("14d", "7d"), ("28d", "7d"), ("28d", "14d")]
    return compare.compare_models(weekly_scores(spark, sf)[1], pairs, ["week", "setting"], REPLICATES)


@query("b3_relative_gaps", final(with_(*PAIRED, *compare_sql(PAIR, "week", REPLICATES, metrics=("ap",)), select="""SELECT week, a_model, b_model, scope, n,
  rel_diff_pct AS rel_pct, '[' || printf('%+.6f', ci_low) || ', ' || printf('%+.6f', ci_high) || ']' || CASE WHEN sig <> 0 THEN ' *' ELSE '' END AS ci FROM cmp"""),
    i="n", f="rel_pct", d="week", s="a_model b_model scope ci"))
def b3(spark, sf):
    return compare.relative_gaps(window_scores(order_folds(spark, sf, (0, 1))), PAIR, ["week"], REPLICATES)
