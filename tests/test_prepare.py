"""Cleaning, ids, splits and their guards."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketline.operators import folds, prepare, profiling
from basketline.plans import preparing
from basketline.sources import logs, sinks


def test_duplicates_are_counted_and_kept(log, day):
    rows = log([(1, 1, day(0), 1.0)] * 3 + [(1, 2, day(0), 1.0), (None, 2, day(0), 1.0), (1, 2, day(0), 0.0)])
    assert prepare.duplicate_rows(rows).first().asDict() == {"n_rows": 6, "n_duplicates": 2}
    assert prepare.clean_transactions(rows).count() == 4
    row = prepare.cleaning_breakdown(rows).first()
    assert (row.n_missing_key, row.n_bad_price, row.n_dropped) == (1, 1, 2)


def test_customer_columns(spark):
    rows = spark.createDataFrame([(3, None, "None", 20.0), (1, 1.0, None, None), (2, 1.0, "Regularly", 40.0)],
                                 "customer_id bigint, FN double, fashion_news_frequency string, age double")
    got = {r.customer_id: r for r in prepare.clean_customers(rows).collect()}
    assert (got[3].FN, got[3].fashion_news_frequency) == (0, "NONE")
    assert (got[1].age, got[1].age_missing, got[1].fashion_news_frequency) == (30.0, 1, "NONE")


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0, 1.0, 3.0], [0.5, 0.25, 7.75, 7.8, 7.8, 100.0]])
def test_median_matches_the_builtin(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert profiling.exact_median(df, "x").first().median == df.agg(F.median("x")).first()[0]


def test_dense_values_are_spread_over_ranges(spark):
    """All values in [0, 1), one far away, half of all rows on one value: no range holds more than a small share."""
    rnd = random.Random(6)
    values = [rnd.random() for _ in range(5000)] + [1e9] + [0.25] * 5000
    df = spark.createDataFrame([(v, "a" if i % 3 else None) for i, v in enumerate(values)], "x double, g string").repartition(4)
    sizes = [r["n"] for r in profiling.ranged(df, "x", ranges=50).groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 50 and max(sizes) < 2 * 5002 / 50
    ordered = sorted(values)
    got = profiling.values_at_ranks(df, "x", {"first": F.lit(1), "mid": F.expr("n div 2"), "last": F.col("n"), "beyond": F.col("n") + 1}, ranges=50).first()
    assert (got["n"], got["first"], got["mid"], got["last"], got["beyond"]) == (10001, ordered[0], ordered[4999], 1e9, None)
    groups = {g: sorted(v for i, v in enumerate(values) if ("a" if i % 3 else None) == g) for g in ("a", None)}
    for r in profiling.values_at_ranks(df, "x", {"mid": F.expr("n div 2 + 1")}, ["g"], ranges=50).collect():
        assert (r["n"], r["mid"]) == (len(groups[r["g"]]), groups[r["g"]][len(groups[r["g"]]) // 2])
    described = profiling.describe_value(df, "x").first()
    assert [described[p] for p in ("p25", "p50", "p75")] == pytest.approx(df.agg(F.percentile("x", F.array(F.lit(.25), F.lit(.5), F.lit(.75)))).first()[0])


def test_dense_ids_follow_sorted_order(spark):
    ids = [f"c{n:05d}" for n in range(2000)]
    df = spark.createDataFrame([(c,) for c in reversed(ids)], "customer_id string").repartition(7)
    got = prepare.customer_id_lookup(df).orderBy("customer_idx").collect()
    assert [(r.customer_id, r.customer_idx) for r in got] == list(zip(ids, range(2000)))


def test_an_unmapped_customer_fails_the_job(spark, log, day):
    lookup = spark.createDataFrame([(1, 0)], "customer_id bigint, customer_idx bigint")
    with pytest.raises(Exception, match="not in the lookup"):
        prepare.apply_customer_idx(log([(1, 1, day(0), 1.0), (2, 1, day(0), 1.0)]), lookup).collect()
    row = prepare.unmapped_customers(log([(1, 1, day(0), 1.0), (3, 1, day(0), 1.0), (2, 1, day(0), 1.0)]), lookup).first()
    assert (row.n_rows, row.n_customers, row.examples) == (2, 2, "2,3")


def test_split_edges(log, day):
    rows = folds.temporal_split(log([(1, n, day(n), 1.0) for n in range(21)]))
    got = {r.article_id: r.split for r in rows.collect()}
    assert [got[n] for n in (6, 7, 13, 14, 20)] == ["train", "val", "val", "test", "test"]
    assert folds.check_split(rows, 21) == {"train": 7, "val": 7, "test": 7}
    with pytest.raises(ValueError, match="expected 22"):
        folds.check_split(rows, 22)


def test_an_empty_split_is_refused(log, day):
    rows = folds.temporal_split(log([(1, 1, day(0), 1.0), (1, 1, day(20), 1.0)]))
    with pytest.raises(ValueError, match="val split is empty"):
        folds.check_split(rows, 2)


def test_folds_do_not_leak(log, day):
    f = folds.build_folds(log([(n % 3, n, day(n), 1.0) for n in range(30)]), folds.fold_weeks(day(20), (0, 1)))
    folds.check_folds(f)
    got = {(r.week, r.lo, r.hi) for r in f.target.groupBy("week").agg(F.min("t_dat").alias("lo"), F.max("t_dat").alias("hi")).collect()}
    assert got == {(day(20), day(20), day(26)), (day(13), day(13), day(19))}
    ends = {r.week: r.hi for r in f.history.groupBy("week").agg(F.max("t_dat").alias("hi")).collect()}
    assert ends == {day(20): day(19), day(13): day(12)}
    with pytest.raises(ValueError, match="lacks sales"):
        folds.check_folds(folds.build_folds(log([(1, 1, day(0), 1.0)]), [day(5)]))
    with pytest.raises(ValueError, match="not known yet"):
        folds.refuse_leak(log([(1, 1, day(5), 1.0)]), day(5))


def test_no_fold_reaches_reserved_days(log, day):
    f = folds.build_folds(log([(1, 1, day(n), 1.0) for n in range(20)]), [day(7)])
    folds.check_folds(f, day(14))
    with pytest.raises(ValueError, match="kept for the final test"):
        folds.check_folds(f, day(13))


def test_fold_dates_reach_the_scan(spark, log, day, tmp_path):
    log([(n % 3, n, day(n), 1.0) for n in range(30)]).write.parquet(str(tmp_path / "log"))
    f = folds.build_folds(spark.read.parquet(str(tmp_path / "log")), [day(20)], history_days=5)
    plan = f.history.select("article_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(t_dat,2024-03-21)" in plan and "GreaterThanOrEqual(t_dat,2024-03-16)" in plan
    assert "price" not in plan.split("ReadSchema")[1]


def test_segments_band_edges(spark, log, day):
    history = log([(c, 1, day(0), 1.0) for c in (1, 2, 2, 3, 3, 3)]).withColumn("week", F.lit(day(1)))
    people = spark.createDataFrame([(day(1), c) for c in range(4)], "week date, customer_id bigint")
    from basketline.operators.segments import segment_customers
    got = [r.segment for r in segment_customers(history, people).orderBy("customer_id").collect()]
    assert got == ["0 purchases", "1-2 purchases", "1-2 purchases", "3+ purchases"]


def test_prepare_flow_writes_every_table(spark, day, tmp_path):
    rows = spark.createDataFrame([(day(n), f"c{n % 3}", n, 1.0, 1) for n in range(21)],
                                 "t_dat date, customer_id string, article_id int, price double, sales_channel_id int")
    people = spark.createDataFrame([(f"c{n}", 1.0, None, 30.0) for n in range(5)],
                                   "customer_id string, FN double, club_member_status string, age double")
    goods = spark.createDataFrame([(n, "text") for n in range(21)], "article_id int, detail_desc string")
    out = str(tmp_path / "prepared")
    assert preparing.run(rows, people, goods, out) == {"train": 7, "val": 7, "test": 7}
    assert sinks.load_split(spark, out, "val", columns=["article_id"]).count() == 7
    assert spark.read.parquet(f"{out}/articles_clean").columns == ["article_id"]
    assert spark.read.parquet(f"{out}/customer_id_lookup").count() == 5


def test_load_prefers_the_parquet_copy(spark, day, tmp_path):
    rows = spark.createDataFrame([(day(0), "a", 1, 0.5, 2)], logs.TRANSACTIONS)
    rows.write.option("header", True).csv(str(tmp_path / "transactions_train.csv"))
    loaded = logs.load_transactions(spark, str(tmp_path))
    assert loaded.schema == rows.schema and loaded.collect() == rows.collect()
    rows.unionByName(rows).write.parquet(str(tmp_path / "transactions_train.parquet"))
    assert logs.load_transactions(spark, str(tmp_path)).count() == 2
    assert isinstance(loaded.first().t_dat, dt.date)


def test_prepared_log_follows_its_tables(spark, tmp_path):
    from basketline.plans.registry import clean_event_log

    def write(n):
        rows = [(i, "purchase", f'{{"k": {i}}}', "2024-01-0%d 10:00:00" % (1 + i % 5), 2.0) for i in range(n)]
        events = spark.createDataFrame(rows, "user_id bigint, event_type string, props string, ts string, value double")
        events.withColumn("ts", F.to_timestamp("ts")).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")

    write(4)
    assert clean_event_log(spark, str(tmp_path)).count() == 4
    write(9)
    assert clean_event_log(spark, str(tmp_path)).count() == 9
