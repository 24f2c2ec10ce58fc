"""Candidate union, recall and point-in-time features on hand-made rows."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketline.operators import candidates, features, popularity


@pytest.fixture
def world(spark, log, day):
    """Day 30 is the target day. Customer 3 has no personal list."""
    week = F.lit(day(30))
    history = log([(1, 10, day(29), 1.0), (1, 11, day(23), 2.0), (2, 10, day(28), 3.0), (2, 12, day(2), 9.0), (1, 10, day(5), 1.0)]).withColumn("week", week)
    people = spark.createDataFrame([(day(30), c) for c in (1, 2, 3)], "week date, customer_id bigint")
    truth = spark.createDataFrame([(day(30), 1, 11), (day(30), 2, 50), (day(30), 3, 10)], "week date, customer_id bigint, article_id bigint")
    personal = spark.createDataFrame([(day(30), 1, 20, 0.9, 1), (day(30), 1, 10, 0.5, 2), (day(30), 2, 12, 0.4, 1), (day(30), 2, 30, 0.1, 3)],
                                     "week date, customer_id bigint, article_id bigint, score double, rank int")
    return history, people, truth, personal


def test_sources_tags_ranks_and_labels(world):
    history, people, truth, personal = world
    got = {(r.customer_id, r.article_id): (r.source, r.als_score, r.source_rank, r.label)
           for r in candidates.candidate_rows(history, people, truth, personal, 2, 1, 28).collect()}
    assert got == {
        (1, 20): ("als", 0.9, 1.0, 0), (1, 10): ("als+pop1+recent", 0.5, 2.0, 0), (1, 11): ("recent", None, None, 1),
        (2, 12): ("als+recent", 0.4, 1.0, 0), (2, 10): ("pop1+recent", None, None, 0),  # rank 3 is beyond n
        (3, 10): ("pop+pop1", None, 1.0, 1), (3, 11): ("pop", None, 2.0, 0)}


def test_recall_counts_missed_customers(world):
    from basketline.operators.segments import segment_customers

    history, people, truth, personal = world
    rows = candidates.candidate_rows(history, people, truth, personal, 2, 1, 28)
    got = {(r.candidates, r.n, r.scope): r for r in
           candidates.candidate_recall(rows, segment_customers(history, people), truth, [1, 2], 1, "all").collect()}
    assert got["als_only", 2, "aggregate"].pair_recall == pytest.approx(1 / 3)
    assert got["all", 1, "aggregate"].pair_recall == pytest.approx(2 / 3)
    assert got["all", 1, "aggregate"].mean_candidates == pytest.approx((3 + 2 + 1) / 3)
    assert got["all", 2, "0 purchases"].customer_coverage == 1.0


def test_recent_window_counts_both_ends(world, day):
    history, people, _, _ = world
    got = {(r.customer_id, r.article_id) for r in candidates.recent_purchases(history, people, 7).collect()}
    assert got == {(1, 10), (1, 11), (2, 10)}  # day 23 is the 7th day back from day 29


def test_feature_values(spark, world, day):
    history, people, truth, personal = world
    rows = candidates.candidate_rows(history, people, truth, personal, 2, 1, 28)
    got = {(r.customer_id, r.article_id): r for r in features.build_features(history.drop("week"), rows, day(30)).collect()}
    a = got[1, 10]
    assert (a.src_als, a.src_pop, a.src_recent, a.als_rank, a.als_score) == (1, 1, 1, 2.0, 0.5)
    assert (a.item_cnt_7d, a.item_cnt_28d, a.ci_count, a.ci_days_since) == (2, 3, 2, 1)
    assert a.item_price_mean_28d == pytest.approx(5 / 3)
    assert got[1, 11].item_cnt_7d == 1  # exactly 7 days before the cutoff
    assert (got[1, 11].als_rank, got[1, 11].als_score) == (None, None)
    unsold = got[1, 20]
    assert (unsold.item_cnt_28d, unsold.item_price_mean_28d, unsold.ci_count, unsold.ci_days_since) == (0, None, 0, None)
    cold = got[3, 10]
    assert (cold.src_als, cold.als_rank, cold.cust_n_purchases, cold.cust_days_since_last) == (0, None, 0, None)
    assert (a.cust_n_purchases, a.cust_days_since_last) == (3, 1)


@pytest.mark.parametrize("offset", [0, 3])
def test_history_on_or_after_the_cutoff_is_refused(spark, world, log, day, offset):
    history, _, _, _ = world
    rows = spark.createDataFrame([(1, 10, "als", 0.1, 1.0)], "customer_id bigint, article_id bigint, source string, als_score double, source_rank double")
    leak = history.drop("week").unionByName(log([(1, 1, day(30 + offset), 1.0)]))
    with pytest.raises(ValueError, match="not known yet"):
        features.build_features(leak, rows, day(30))


def test_exclusion_fills_lists_past_what_is_owned(spark, log, day):
    rows = [(9, a, day(0), 1.0) for a in range(30) for _ in range(40 - a)] + [(1, a, day(0), 1.0) for a in range(25)]
    history = log(rows).withColumn("week", F.lit(day(1)))
    people = spark.createDataFrame([(day(1), 1), (day(1), 2)], "week date, customer_id bigint")
    got = {r.customer_id: r["items"] for r in popularity.exclusion_lists(people, history, [7]).collect()}
    assert got == {1: [25, 26, 27, 28, 29], 2: list(range(12))}
    both = {(r.customer_id, r.exclusion): r["items"] for r in popularity.recency_lists(people, history, [7]).collect()}
    old = history.unionByName(log([(1, 27, day(-400), 1.0)]).withColumn("week", F.lit(day(1))))
    assert popularity.exclusion_lists(people, old, [7]).where("customer_id = 1").first()["items"] == [25, 26, 28, 29]
    assert both[1, True] == got[1] and both[1, False] == both[2, True] == list(range(12))


def test_one_customer_who_owns_everything_changes_nobody_else(spark, log, day):
    """Lists against plain Python; what is broadcast stays 2 k deep."""
    rnd = random.Random(8)
    rows = [(c, a, day(rnd.randint(0, 20)), 1.0) for c in range(2, 40) for a in rnd.sample(range(200), rnd.randint(1, 30))]
    rows += [(1, a, day(-30), 1.0) for a in range(200)] + [(7, a, day(5), 1.0) for a in range(120)]
    history = log(rows).withColumn("week", F.lit(day(21)))
    people = spark.createDataFrame([(day(21), c) for c in range(45)], "week date, customer_id bigint")
    want = {}
    for label, days in (("7d", 7), ("all-time", 10_000)):
        sold = Counter(a for _, a, d, _ in rows if d > day(20) - dt.timedelta(days=days))
        ranked = sorted(sold, key=lambda a: (-sold[a], a))
        for c in range(45):
            own = {a for x, a, _, _ in rows if x == c}
            want[c, label, True], want[c, label, False] = [a for a in ranked if a not in own][:5], ranked[:5]
    lists = popularity.recency_lists(people, history, [7, None], 5)
    assert {(r.customer_id, r.window, r.exclusion): r["items"] for r in lists.collect()} == want
    assert want[1, "7d", True] == [] and lists.count() == 180
    only = popularity.exclusion_lists(people, history, [7, None], 5)
    assert {(r.customer_id, r.window, True): r["items"] for r in only.collect()} == {k: v for k, v in want.items() if k[2]}
