"""Denominators, duplicates, empty lists and empty slices."""

import pytest
from pyspark.sql import functions as F

from basketline.operators import metrics

KEYS = ["week", "customer_id"]


@pytest.fixture
def scored(spark, day):
    def run(lists, truth, k=12):
        l = spark.createDataFrame([(day(0), c, items) for c, items in lists], "week date, customer_id bigint, items array<bigint>")
        t = spark.createDataFrame([(day(0), c, a) for c, a in truth], "week date, customer_id bigint, article_id bigint")
        return metrics.customer_scores(l, t, KEYS, k)
    return run


def test_average_precision(scored):
    row = scored([(1, [9, 5, 8, 6])], [(1, 5), (1, 6), (1, 7)]).first()
    assert (row.hits, row.n_true, row.hit) == (2, 3, 1.0)
    assert row.ap == pytest.approx((1 / 2 + 2 / 4) / 3)


def test_a_repeated_item_credits_once_but_uses_a_rank(scored):
    row = scored([(1, [5, 5, 6])], [(1, 5), (1, 6)]).first()
    assert row.ap == pytest.approx((1 / 1 + 2 / 3) / 2)


def test_only_the_first_k_count_and_truth_is_capped_at_k(scored):
    row = scored([(1, [1, 2, 3])], [(1, n) for n in range(1, 6)], k=2).first()
    assert (row.hits, row.ap) == (2, 1.0)


def test_customers_without_truth_lower_only_the_hit_rate(scored):
    row = metrics.metrics(scored([(1, [5]), (2, [5])], [(1, 5)])).first()
    assert (row.n_customers, row.hit_rate, row.map, row.recall) == (2, 0.5, 1.0, 1.0)
    assert row.precision == pytest.approx(1 / 12)


def test_an_empty_list_scores_zero_and_an_empty_slice_is_null(scored):
    assert scored([(1, [])], [(1, 5)]).first().ap == 0.0
    empty = metrics.metrics(scored([(1, [5])], [(1, 5)]).filter(F.lit(False))).first()
    assert (empty.map, empty.hit_rate, empty.precision) == (None, None, None)


def test_two_routes_to_ap_agree(spark, day, scored):
    lists = [(c, [(c * 7 + j * 3) % 20 for j in range(12)]) for c in range(40)]
    truth = sorted({(c, (c * 5 + j) % 20) for c in range(40) for j in range(6)})
    one = {r.customer_id: r.ap for r in scored(lists, truth).collect()}
    l = spark.createDataFrame([(day(0), c, i) for c, i in lists], "week date, customer_id bigint, items array<bigint>")
    t = spark.createDataFrame([(day(0), c, a) for c, a in truth], "week date, customer_id bigint, article_id bigint")
    two = {r.customer_id: r.ap for r in metrics.map_by_positions(l, t, KEYS).collect()}
    assert one == pytest.approx(two)
