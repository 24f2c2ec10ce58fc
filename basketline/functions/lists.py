"""Recommendation lists: array form (one row per customer) and its text literal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group under a total order; Spark prunes each task to k rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def to_lists(ranked: DataFrame, by: Sequence[str], item: str = "article_id", rank: str = "rank",
             out: str = "items") -> DataFrame:
    """Ranked rows to one array per group, best first. The caller has bounded the group to k rows."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(rank), F.col(item))))
    return ranked.groupBy(*by).agg(F.transform(pairs, lambda p: p[item]).alias(out))


def to_rows(lists: DataFrame, items: str = "items") -> DataFrame:
    """One row per list position with a 1-based rank; empty lists give no row."""
    rest = [c for c in lists.columns if c != items]
    return lists.select(*rest, F.posexplode(items).alias("pos", "article_id")).select(
        *rest, (F.col("pos") + 1).alias("rank"), "article_id")


def array_literal(items: Column | str) -> Column:
    """{a,b,c}, the form a database array column loads."""
    column = F.col(items) if isinstance(items, str) else items
    return F.concat(F.lit("{"), F.array_join(column.cast("array<string>"), ","), F.lit("}"))


def parse_array_literal(text: Column | str, element: str = "bigint") -> Column:
    column = F.col(text) if isinstance(text, str) else text
    inner = F.btrim(F.btrim(column), F.lit("{}"))
    parts = F.when(F.btrim(inner) == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))
    return parts.cast(f"array<{element}>")
