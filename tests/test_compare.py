"""Bootstrap, intervals, verdicts, weekly summaries and the sweep rule."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketline.operators import compare

SEGMENT = "3+ purchases"


@pytest.fixture(scope="module")
def scores(spark):
    """Model b scores higher than a by 0.1 on average; c equals a."""
    rng = np.random.default_rng(4)
    rows = []
    for c in range(300):
        a = float(rng.random())
        rows += [(c, SEGMENT if c % 3 else "0 purchases", m, v, 1.0) for m, v in
                 (("a", a), ("b", a + float(rng.normal(0.1, 0.3))), ("c", a))]
    return spark.createDataFrame(rows, "customer_id bigint, segment string, model string, ap double, hit double").withColumn("week", F.lit(1))


def test_poisson_draws_have_mean_and_variance_one():
    draws = compare.drawn_weights([str(c) for c in range(400)], 80, 42).astype(float)
    assert draws.mean() == pytest.approx(1, abs=0.02) and draws.var() == pytest.approx(1, abs=0.04)
    assert (draws == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    hexed = md5(b"42|3|17").hexdigest()
    assert draws[17, 24:32].tolist() == [sum(hexed[4 * j:4 * j + 4] >= c for c in compare.poisson_cuts()) for j in range(8)]


@pytest.mark.parametrize("most", [1, 64])
def test_replicate_sums_match_a_loop(monkeypatch, spark, most):
    """Missing values, several groups, customers in several rows, accumulators that are sent early."""
    monkeypatch.setattr(compare, "MOST_GROUPS", most)
    monkeypatch.setattr(compare, "DRAWN_CELLS", 100)
    rows = [(g, c, "s" if c % 2 else "t", None if c % 7 == 0 else c * 0.5, None) for g in (1, 2, None) for c in range(g or 5, 30)]
    df = spark.createDataFrame(rows, "week int, customer_id bigint, segment string, d double, e double").repartition(3)
    got = compare.poisson_bootstrap(df, ["week"], {"d": F.col("d"), "e": F.col("e")}, 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "range(" not in plan and "sequence(" not in plan  # nothing is generated per replicate
    weights = {c: compare.drawn_weights([str(c)], 20, 42)[0] for c in range(30)}
    want = {}
    for g in (1, 2, None):
        for scope in ("aggregate", "s", "t"):
            own = [(c, d) for w, c, s, d, _ in rows if w == g and scope in ("aggregate", s)]
            for r in range(20):
                total = sum(int(weights[c][r]) for c, _ in own)
                known = [(int(weights[c][r]), d) for c, d in own if d is not None and weights[c][r]]
                if total:
                    want[g, scope, r] = pytest.approx(sum(w * d for w, d in known) / total) if known else None
    found = {(r.week, r.scope, r.replicate): r.d for r in got.collect()}
    assert found == want and all(r.e is None for r in got.collect())


def test_intervals_match_a_numpy_bootstrap(scores):
    rows = compare.compare_models(scores, [("b", "a")], ["week"], 2000, metrics=("ap",), scopes=("aggregate",)).first()
    d = np.array([r.d for r in compare.pair_differences(scores, [("b", "a")], ["week"], ("ap",)).collect()])
    rng = np.random.default_rng(0)
    low, high = np.percentile(d[rng.integers(0, len(d), (2000, len(d)))].mean(axis=1), [2.5, 97.5])
    assert rows["diff"] == pytest.approx(d.mean())
    assert (rows.ci_low, rows.ci_high) == pytest.approx((low, high), abs=0.004)
    assert (rows.sig, rows.verdict) == (1, "b > a")


def test_resampling_takes_exactly_n_draws(scores):
    diffs = compare.pair_differences(scores, [("b", "a")], ["week"], ("ap",))
    means = compare.resample_bootstrap(diffs, ["week"], 500)
    poisson = compare.poisson_bootstrap(diffs, ["week"], {"mean": F.col("d")}, 500, segment=None)
    one, two = compare.intervals(means, ["week"]).first(), compare.intervals(poisson, ["week"]).first()
    assert means.count() == 500
    assert (one.ci_low, one.ci_high) == pytest.approx((two.ci_low, two.ci_high), abs=0.01)


def test_equal_models_are_identical(scores):
    rows = compare.compare_models(scores, [("c", "a")], ["week"], 50, metrics=("ap",)).collect()
    assert {(r.ci_low, r.ci_high, r.sig, r.verdict) for r in rows} == {(0.0, 0.0, 0, "identical")}
    assert {r.scope: r.n for r in rows} == {"aggregate": 300, "0 purchases": 100, SEGMENT: 200}


def test_weekly_summary(spark):
    rows = spark.createDataFrame([(1, "p", 5.0, 1), (2, "p", -2.0, 0), (3, "p", 3.0, 0), (1, "q", -1.0, -1)],
                                 "week int, pair string, rel_diff_pct double, sig int")
    got = {r.pair: r for r in compare.summarize_weeks(rows, [1, 2, 3], ["pair"]).collect()}
    p = got["p"]
    assert (p["wk 1"], p["wk 2"], p["wk 3"]) == ("+5.0*", "-2.0", "+3.0")
    assert p["mean"] == 2.0 and p["sd"] == pytest.approx(np.std([5, -2, 3], ddof=1))
    assert (p.weeks_a_ahead_sig, p.weeks_b_ahead_sig, p.weeks_a_ahead_any) == (1, 0, 2)
    assert (got["q"].sd, got["q"]["wk 2"], got["q"].weeks_b_ahead_sig) == (None, None, 1)


def test_candidate_rule(spark):
    rows = [(w, c, s, g, sig) for c, s, g, sig in
            (("good", "on", 4.0, 1), ("good", "off", 3.0, 0), ("one", "on", 9.0, 1), ("low", "on", 4.0, 0), ("low", "off", 2.9, 0),
             ("worse", "on", 9.0, -1), ("worse", "off", 9.0, 0)) for w in (1, 2)]
    rows += [(1, "short", s, 9.0, 1) for s in ("on", "off")]
    df = spark.createDataFrame(rows, "week int, config string, setting string, rel_map_pct double, sig int")
    got = {r.config: r.candidate for r in compare.candidate_configs(df, [1, 2]).collect()}
    assert got == {"good": True, "one": False, "low": False, "worse": False, "short": False}
