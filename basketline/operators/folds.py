"""Date splits and weekly folds: who buys in the target days, and the history before them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.operators.segments import segment_customers

SPLIT_ORDER = ("train", "val", "test")


def last_day(log: DataFrame) -> dt.date:
    """The last sale day; a one-column aggregate whose result becomes a literal the scan can prune on."""
    return log.agg(F.max("t_dat")).first()[0]


def split_starts(max_day: dt.date, val_weeks: int = 1, test_weeks: int = 1) -> tuple[dt.date, dt.date]:
    test_start = max_day - dt.timedelta(weeks=test_weeks) + dt.timedelta(days=1)
    return test_start - dt.timedelta(weeks=val_weeks), test_start


def temporal_split(log: DataFrame, val_weeks: int = 1, test_weeks: int = 1) -> DataFrame:
    """One global date cutoff, as a ``split`` column (also the write partition)."""
    val_start, test_start = split_starts(last_day(log), val_weeks, test_weeks)
    return log.withColumn(
        "split",
        F.when(F.col("t_dat") < F.lit(val_start), "train")
        .when(F.col("t_dat") < F.lit(test_start), "val").otherwise("test"))


def split_counts(split_log: DataFrame) -> DataFrame:
    return split_log.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def check_split(split_log: DataFrame, expected_rows: int) -> dict[str, int]:
    """Rows are conserved and the held-out splits are not empty."""
    counts = {r["split"]: r["n"] for r in split_counts(split_log).collect()}
    if sum(counts.values()) != expected_rows:
        raise ValueError(f"splits hold {sum(counts.values())} rows, expected {expected_rows}")
    for name in ("val", "test"):
        if not counts.get(name):
            raise ValueError(f"the {name} split is empty; the data does not span enough weeks")
    return counts


@dataclass(frozen=True)
class Folds:
    """History and target rows of one or more folds, keyed by ``week`` (the first target day)."""

    weeks: tuple[dt.date, ...]
    history: DataFrame
    target: DataFrame

    @property
    def customers(self) -> DataFrame:
        return self.target.select("week", "customer_id").distinct()

    @property
    def truth(self) -> DataFrame:
        return self.target.select("week", "customer_id", "article_id").distinct()

    def segmented_customers(self) -> DataFrame:
        return segment_customers(self.history, self.customers)


def fold_weeks(latest: dt.date, offsets: Sequence[int], step_days: int = 7) -> tuple[dt.date, ...]:
    return tuple(latest - dt.timedelta(days=step_days * k) for k in offsets)


def build_folds(log: DataFrame, weeks: Sequence[dt.date], target_days: int = 7,
                history_days: int | None = None) -> Folds:
    """All folds in one pass: a row is tagged with every fold whose date range it falls in.

    The tags are literals, so each side keeps a plain date range that reaches the scan.
    """
    first, last = min(weeks), max(weeks)
    span = dt.timedelta(days=target_days)

    def tagged(rows: DataFrame, keep) -> DataFrame:
        if len(weeks) == 1:
            return rows.withColumn("week", F.lit(weeks[0]))
        tags = F.array(*[F.when(keep(F.lit(w)), F.lit(w)) for w in weeks])
        return rows.withColumn("week", F.explode(tags)).filter(F.col("week").isNotNull())

    past = log.filter(F.col("t_dat") < F.lit(last))
    if history_days is not None:
        past = past.filter(F.col("t_dat") >= F.lit(first - dt.timedelta(days=history_days)))
    ahead = log.filter((F.col("t_dat") >= F.lit(first)) & (F.col("t_dat") < F.lit(last + span)))

    def in_history(week):
        inside = F.col("t_dat") < week
        if history_days is not None:
            inside &= F.col("t_dat") >= F.date_sub(week, history_days)
        return inside

    def in_target(week):
        return (F.col("t_dat") >= week) & (F.col("t_dat") < F.date_add(week, target_days))

    return Folds(tuple(weeks), tagged(past, in_history), tagged(ahead, in_target))


def check_folds(folds: Folds, reserved_from: dt.date | None = None) -> None:
    """Each week has a past and target rows, the past ends before them, and none of them lies in the reserved test split."""
    past = folds.history.groupBy("week").agg(F.max("t_dat").alias("last_known"))
    ahead = folds.target.groupBy("week").agg(F.min("t_dat").alias("first_asked"), F.max("t_dat").alias("last_asked"))
    found = {r["week"]: r for r in past.join(ahead, "week").collect()}  # a row for a week
    for week in folds.weeks:
        row = found.get(week)
        if row is None:
            raise ValueError(f"week {week} lacks sales to learn from or to predict")
        if row["last_known"] >= row["first_asked"]:
            raise ValueError(f"week {week} would learn from {row['last_known']}, a day it has to predict")
        if reserved_from is not None and row["last_asked"] >= reserved_from:
            raise ValueError(f"week {week} predicts {row['last_asked']}, which is kept for the final test")


def refuse_leak(history: DataFrame, cutoff: dt.date) -> None:
    """Point-in-time guard: no history row on or after the cutoff."""
    latest = history.agg(F.max("t_dat")).first()[0]
    if latest is not None and latest >= cutoff:
        raise ValueError(f"a sale of {latest} is not known yet at the cutoff {cutoff}")
