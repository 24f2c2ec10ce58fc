"""The four trailing windows: edges, and where they part ways."""

from pyspark.sql import functions as F

from basketline.functions import windows
from basketline.operators import folds, popularity


def days(df):
    return sorted(r.t_dat for r in df.collect())


def test_windows_agree_when_the_last_day_has_a_sale(log, day):
    rows = log([(1, 1, day(n), 1.0) for n in range(20)])
    want = [day(n) for n in range(13, 20)]
    assert days(windows.last_days_of_history(rows, 7)) == want
    assert days(windows.calendar_days_of_history(rows, 7)) == want
    assert days(windows.days_ending_at(rows, F.lit(day(19)), 7)) == want
    assert days(rows.filter(windows.days_before_cutoff(F.lit(day(20)), 7))) == want


def test_a_gap_slides_back_only_the_windows_anchored_on_the_data(log, day):
    rows = log([(1, 1, day(n), 1.0) for n in range(15)])
    slid, fixed = [day(n) for n in range(8, 15)], [day(13), day(14)]
    assert days(windows.last_days_of_history(rows, 7)) == slid
    assert days(windows.calendar_days_of_history(rows, 7)) == slid
    assert days(windows.days_ending_at(rows, F.lit(day(19)), 7)) == fixed
    assert days(rows.filter(windows.days_before_cutoff(F.lit(day(20)), 7))) == fixed


def test_as_of_window_edges_and_ties(log, day):
    rows = [(1, 5, day(20), 1.0), (1, 6, day(14), 1.0), (1, 7, day(13), 1.0), (1, 8, day(21), 1.0), (1, 4, day(20), 1.0)]
    top = popularity.recent_top(log(rows), F.lit(day(20)), 7, 12).orderBy("rank").collect()
    assert [r.article_id for r in top] == [4, 5, 6]  # day 13 is too old, day 21 too new; ties by id
    assert [r.article_id for r in popularity.recent_top(log(rows), F.lit(day(20)), 7, 2).orderBy("rank").collect()] == [4, 5]


def test_window_counts_in_one_pass(log, day):
    rows = log([(1, 1, day(30), 1.0), (1, 2, day(24), 1.0), (1, 3, day(23), 1.0), (2, 3, day(2), 1.0)]).withColumn("week", F.lit(day(31)))
    got = {(r.window, r.article_id): r.cnt for r in popularity.window_counts(rows, [7, 28, None]).collect()}
    assert got == {("7d", 1): 1, ("7d", 2): 1, ("28d", 1): 1, ("28d", 2): 1, ("28d", 3): 1,
                   ("all-time", 1): 1, ("all-time", 2): 1, ("all-time", 3): 2}


def test_recent_window_reaches_the_scan(spark, log, day, tmp_path):
    """Both ends of a trailing window are date filters of the scan, for one fold and for several."""
    log([(n % 3, n, day(n), 1.0) for n in range(30)]).write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    for weeks in ([day(20)], [day(20), day(27)]):
        history = folds.build_folds(stored, weeks).history
        plan = popularity.window_counts(history, [7])._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: ")[1].split("]")[0]
        assert "LessThan(t_dat" in pushed and "GreaterThan(t_dat" in pushed, pushed
        counts = {(r.week, r.article_id): r.cnt for r in popularity.window_counts(history, [7]).collect()}
        assert counts == {(w, n): 1 for w in weeks for n in range(30) if 0 < (w - day(n)).days <= 7}
