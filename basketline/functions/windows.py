"""The four trailing-window definitions. They agree on dense daily data and part ways at gaps."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_TIME = "all-time"


def window_label(days: int | None) -> str:
    return ALL_TIME if days is None else f"{days}d"


def last_days_of_history(history: DataFrame, days: int) -> DataFrame:
    """t_dat > last sale - days; slides back when the history ends early."""
    last = history.agg(F.max("t_dat")).scalar()
    return history.filter(F.col("t_dat") > F.date_sub(last, days))


def days_ending_at(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """as_of - days < t_dat <= as_of; anchored on the parameter, not on the data."""
    return log.filter((F.col("t_dat") > F.date_sub(as_of, days)) & (F.col("t_dat") <= as_of))


def calendar_days_of_history(history: DataFrame, days: int) -> DataFrame:
    """t_dat >= last sale - (days - 1)."""
    last = history.agg(F.max("t_dat")).scalar()
    return history.filter(F.col("t_dat") >= F.date_sub(last, days - 1))


def history_ends(history: DataFrame) -> list[tuple]:
    """(week, last history day) of every fold: one row for a fold, so that window bounds become literals."""
    return [tuple(r) for r in history.groupBy("week").agg(F.max("t_dat")).collect()]


def days_of_history(history: DataFrame, ends: list[tuple], days: int) -> DataFrame:
    """t_dat > last history day - days of each fold; the widest range is a plain date filter that reaches the scan."""
    if not ends:
        return history.filter("false")
    first = min(end for _, end in ends) - dt.timedelta(days=days)
    inside = [(F.col("week") == F.lit(week)) & (F.col("t_dat") > F.lit(end - dt.timedelta(days=days))) for week, end in ends]
    return history.filter(F.col("t_dat") > F.lit(first)).filter(reduce(Column.__or__, inside))


def days_before_cutoff(cutoff: Column, days: int) -> Column:
    """cutoff - days <= t_dat < cutoff, as a condition for one-pass conditional aggregates."""
    return (F.col("t_dat") >= F.date_sub(cutoff, days)) & (F.col("t_dat") < cutoff)
