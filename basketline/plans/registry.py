"""Registered queries: a Spark plan over the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketline.operators.folds import Folds, build_folds, fold_weeks, last_day
from basketline.operators.prepare import clean_transactions
from basketline.session import changed_at, path_exists, scratch_path
from basketline.sources import logs
from basketline.sources.sinks import laid_out_by_day

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[name] = Query(lambda spark, sf_dir: comparable(build(spark, sf_dir)), sql)
        return build
    return add


def comparable(df: DataFrame) -> DataFrame:
    """Types both engines print alike: bigint, double to 6 decimals, text dates and joined lists."""
    out = []
    for f in df.schema.fields:
        c, name = F.col(f"`{f.name}`"), f.name
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            r = F.round(c.cast("double"), 6)
            c = F.when(r == 0, 0.0).otherwise(r)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(name))
    return df.select(*out)


def final(sql: str, i: str = "", f: str = "", d: str = "", s: str = "", a: str = "") -> str:
    """Wrap SQL so that its columns (ints, floats, dates, as they are, arrays) print like comparable()."""
    def q(c: str) -> str:
        return f'"{c}"'
    cols = [f"CAST({q(c)} AS BIGINT) AS {q(c)}" for c in i.split()]
    cols += [f"CASE WHEN round(CAST({q(c)} AS DOUBLE), 6) = 0 THEN CAST(0 AS DOUBLE) "
             f"ELSE round(CAST({q(c)} AS DOUBLE), 6) END AS {q(c)}" for c in f.split()]
    cols += [f"CAST({q(c)} AS VARCHAR) AS {q(c)}" for c in d.split()]
    cols += [q(c) for c in s.split()]
    cols += [f"array_to_string({q(c)}, ',') AS {q(c)}" for c in a.split()]
    head, body = split_with(sql)
    return f"{head}SELECT {', '.join(cols)} FROM ({body}) final_rows"


def split_with(sql: str) -> tuple[str, str]:
    """(WITH clause, SELECT) of SQL made by with_()."""
    if "\n-- select\n" in sql:
        head, body = sql.split("\n-- select\n", 1)
        return head + "\n", body
    return "", sql


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n-- select\n" + select


# The two logs, cleaned, and their folds ------------------------------------------------------

ORDER_LOG = """lg AS (SELECT o_custkey AS customer_id, l_partkey AS article_id, CAST(o_orderdate AS DATE) AS t_dat,
  l_extendedprice AS price, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS sales_channel_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EVENT_LOG = """lg AS (SELECT user_id AS customer_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS article_id,
  CAST(ts AS DATE) AS t_dat, value AS price, 1 AS sales_channel_id FROM events WHERE event_type = 'purchase')"""
CLEAN = "clean AS (SELECT * FROM lg WHERE customer_id IS NOT NULL AND article_id IS NOT NULL AND t_dat IS NOT NULL AND price > 0)"
BAND = "CASE WHEN {n} = 0 THEN '0 purchases' WHEN {n} <= 2 THEN '1-2 purchases' ELSE '3+ purchases' END"

ORDER_TARGET = 28  # order lines are sparse: a longer target


_PREPARED: dict[tuple, str] = {}
SOURCE_TABLES = {"order_log": ("orders", "lineitem"), "event_log": ("events",)}


def prepared_log(spark: SparkSession, sf_dir: str, source: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The cleaned log, written once per application and state of its tables, in date order; later queries prune on its dates."""
    state = tuple(changed_at(spark, f"{sf_dir}/{t}.parquet") for t in SOURCE_TABLES[source.__name__])
    key = (spark.sparkContext.applicationId, sf_dir, source.__name__, state)
    if key not in _PREPARED or not path_exists(spark, f"{_PREPARED[key]}/_SUCCESS"):
        path = scratch_path(spark, source.__name__)
        laid_out_by_day(clean_transactions(source(spark, sf_dir))).write.parquet(path)
        _PREPARED[key] = path
    return spark.read.parquet(_PREPARED[key])


def clean_order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_log(spark, sf_dir, logs.order_log)


def clean_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_log(spark, sf_dir, logs.event_log)


def order_folds(spark: SparkSession, sf_dir: str, offsets: Sequence[int] = (0,)) -> Folds:
    log = clean_order_log(spark, sf_dir)
    latest = last_day(log) - dt.timedelta(days=ORDER_TARGET - 1)
    return build_folds(log, fold_weeks(latest, offsets, ORDER_TARGET), ORDER_TARGET)


def event_folds(spark: SparkSession, sf_dir: str, offsets: Sequence[int] = (0,)) -> Folds:
    log = clean_event_log(spark, sf_dir)
    return build_folds(log, fold_weeks(last_day(log) - dt.timedelta(days=6), offsets), 7)


def _folds_sql(log: str, offsets: Sequence[int], days: int) -> list[str]:
    ks = ", ".join(f"({k})" for k in offsets)
    return [
        log, CLEAN,
        f"fw AS (SELECT (SELECT max(t_dat) FROM clean) - {days - 1} - {days} * k AS week FROM (VALUES {ks}) v(k))",
        f"h AS (SELECT week, c.* FROM clean c JOIN fw ON t_dat < week)",
        f"t AS (SELECT week, c.* FROM clean c JOIN fw ON t_dat >= week AND t_dat < week + {days})",
        "truth AS (SELECT DISTINCT week, customer_id, article_id FROM t)",
        f"""cust AS (SELECT week, customer_id, coalesce(n, 0) AS n_purchases, {BAND.format(n='coalesce(n, 0)')} AS segment
  FROM (SELECT DISTINCT week, customer_id FROM t)
  LEFT JOIN (SELECT week, customer_id, count(*) AS n FROM h GROUP BY ALL) USING (week, customer_id))"""]


def order_folds_sql(offsets: Sequence[int] = (0,)) -> list[str]:
    return _folds_sql(ORDER_LOG, offsets, ORDER_TARGET)


def event_folds_sql(offsets: Sequence[int] = (0,)) -> list[str]:
    return _folds_sql(EVENT_LOG, offsets, 7)


# Shared SQL steps --------------------------------------------------------------------------

def pools_sql(windows: Sequence[int | None]) -> list[str]:
    """wc: counts per (week, window, article); pool: all of each, ranked."""
    parts = []
    for d in windows:
        label, cond = (f"{d}d", f"t_dat > he - {d}") if d is not None else ("all-time", "true")
        parts.append(f"SELECT week, '{label}' AS \"window\", article_id, count(*) AS cnt FROM h JOIN hend USING (week) "
                     f"WHERE {cond} GROUP BY ALL")
    return ["hend AS (SELECT week, max(t_dat) AS he FROM h GROUP BY week)",
            "wc AS (" + " UNION ALL ".join(parts) + ")",
            """pool AS (SELECT *, row_number() OVER (PARTITION BY week, "window" ORDER BY cnt DESC, article_id) AS rank FROM wc)"""]


PLAIN_LISTS = """plain AS (SELECT c.week, c.customer_id, c.segment, p."window", false AS exclusion, p.rank, p.article_id
  FROM cust c JOIN pool p USING (week) WHERE p.rank <= 12)"""
KEPT_LISTS = """kept AS (SELECT * FROM (SELECT c.week, c.customer_id, c.segment, p."window", true AS exclusion,
  row_number() OVER (PARTITION BY c.week, c.customer_id, p."window" ORDER BY p.rank) AS rank, p.article_id
  FROM cust c JOIN pool p USING (week) WHERE NOT EXISTS (SELECT 1 FROM h
    WHERE h.week = c.week AND h.customer_id = c.customer_id AND h.article_id = p.article_id)) WHERE rank <= 12)"""
RECENCY_LISTS = "rl AS (SELECT * FROM plain UNION ALL SELECT * FROM kept)"


def recency_sql(windows: Sequence[int | None]) -> list[str]:
    return [*pools_sql(windows), PLAIN_LISTS, KEPT_LISTS, RECENCY_LISTS]


def scores_sql(lists: str, keys: str, models: str, k: int = 12) -> list[str]:
    """sc: ap, hit, hits, n_true per (week, customer, keys). models lists every key combination."""
    cols = [c.strip() for c in keys.split(",")]
    names = ", ".join(cols)
    frame = ", ".join(f"m.{c}" for c in cols)
    return [
        "nt AS (SELECT week, customer_id, count(*) AS n_true FROM truth GROUP BY ALL)",
        f"frame AS (SELECT c.week, c.customer_id, c.segment, {frame} FROM cust c CROSS JOIN ({models}) m)",
        f"""hit0 AS (SELECT l.week, l.customer_id, {', '.join('l.' + c for c in cols)}, l.article_id, min(l.rank) AS rank
  FROM {lists} l JOIN truth USING (week, customer_id, article_id) WHERE l.rank <= {k} GROUP BY ALL)""",
        f"hit1 AS (SELECT *, row_number() OVER (PARTITION BY week, customer_id, {names} ORDER BY rank) AS hn FROM hit0)",
        f"""sc AS (SELECT f.week, f.customer_id, f.segment, {', '.join('f.' + c for c in cols)}, n_true, count(hn) AS hits,
  coalesce(sum(hn / rank), 0) / least(n_true, {k}) AS ap, CASE WHEN count(hn) > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS hit
  FROM frame f JOIN nt USING (week, customer_id) LEFT JOIN hit1 USING (week, customer_id, {names})
  GROUP BY f.week, f.customer_id, f.segment, {', '.join('f.' + c for c in cols)}, n_true)"""]


SCOPED = "sc2 AS (SELECT *, unnest(['aggregate', segment]) AS scope FROM sc)"
METRICS = """count(*) AS n_customers, avg(hits / 12) AS "precision", avg(hits / n_true) AS recall,
  avg(hit) AS hit_rate, avg(ap) AS "map\""""


def bootstrap_sql(replicates: int, seed: int = 42) -> list[str]:
    """wt: Poisson(1) weight per customer and replicate, from 16 bits of an md5."""
    from basketline.operators.compare import poisson_cuts

    weight = " + ".join(f"(hx >= '{c}')::INT" for c in poisson_cuts())
    blocks = -(-replicates // 8)
    return [f"""wt AS (SELECT customer_id, replicate, {weight} AS w FROM (SELECT customer_id, b * 8 + j AS replicate,
  substr(md5('{seed}|' || b || '|' || customer_id), CAST(1 + 4 * j AS INT), 4) AS hx
  FROM (SELECT DISTINCT customer_id FROM cust), range(0, {blocks}) x(b), range(0, 8) y(j)) WHERE replicate < {replicates})"""]


def compare_sql(pairs: Sequence[tuple[str, str]], by: str, replicates: int, seed: int = 42,
                metrics: Sequence[str] = ("ap", "hit"), where: str = "true") -> list[str]:
    """cmp: point difference, interval, sign and verdict per (by, pair, metric, scope) out of sc (model column)."""
    cols = [c.strip() for c in by.split(",")]
    parts = [f"""SELECT {', '.join('a.' + c for c in cols)}, a.customer_id, a.segment, a.model AS a_model, b.model AS b_model,
  '{x}' AS metric, a.{x} AS a, b.{x} AS b, a.{x} - b.{x} AS d FROM sc a JOIN sc b USING ({by}, customer_id)
  WHERE a.model = '{m}' AND b.model = '{o}'""" for m, o in pairs for x in metrics]
    keys = f"{by}, a_model, b_model, metric, scope"
    return [
        "df AS (" + " UNION ALL ".join(parts) + ")",
        "df2 AS (SELECT *, unnest(['aggregate', segment]) AS scope FROM df)",
        *bootstrap_sql(replicates, seed),
        f"bm AS (SELECT {keys}, replicate, sum(w * d) / sum(w) AS mean FROM df2 JOIN wt USING (customer_id) WHERE w > 0 GROUP BY ALL)",
        f"""ci AS (SELECT {keys}, round(quantile_cont(mean, 0.025), 12) AS lo, round(quantile_cont(mean, 0.975), 12) AS hi
  FROM bm GROUP BY ALL)""",
        f"""pt AS (SELECT {keys}, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS diff, max(abs(d)) AS widest
  FROM df2 GROUP BY ALL)""",
        f"""cmp AS (SELECT {keys}, n, mean_a, mean_b, diff, CASE WHEN widest = 0 THEN 0 ELSE lo END AS ci_low,
  CASE WHEN widest = 0 THEN 0 ELSE hi END AS ci_high, 100 * diff / nullif(mean_b, 0) AS rel_diff_pct,
  CASE WHEN widest = 0 THEN 0 WHEN lo > 0 THEN 1 WHEN hi < 0 THEN -1 ELSE 0 END AS sig,
  CASE WHEN widest = 0 THEN 'identical' WHEN lo > 0 THEN a_model || ' > ' || b_model
    WHEN hi < 0 THEN b_model || ' > ' || a_model ELSE 'no clear difference' END AS verdict
  FROM pt LEFT JOIN ci USING ({keys}) WHERE {where})"""]


def item_item_sql(k: int = 12) -> list[str]:
    """One week: sim over the catalogue, and iil: ranked lists under both settings."""
    return [
        """items AS (SELECT article_id, row_number() OVER (ORDER BY count(*) DESC, article_id) - 1 AS col
  FROM h GROUP BY article_id)""",
        "pairs AS (SELECT DISTINCT customer_id, article_id, col FROM h JOIN items USING (article_id))",
        "held AS (SELECT col, count(*) AS n FROM pairs GROUP BY col)",
        """sim AS (SELECT p.col AS a, q.col AS b, count(*) / sqrt(CAST(max(x.n) AS DOUBLE) * max(y.n)) AS sim
  FROM pairs p JOIN pairs q USING (customer_id) JOIN held x ON x.col = p.col JOIN held y ON y.col = q.col GROUP BY p.col, q.col)""",
        "known AS (SELECT DISTINCT customer_id FROM pairs JOIN cust USING (customer_id))",
        "got AS (SELECT customer_id, b AS col, sum(sim) AS score FROM pairs JOIN sim ON a = col GROUP BY ALL)",
        """every AS (SELECT u.customer_id, i.col, i.article_id, round(coalesce(g.score, 0), 9) AS score, o.col IS NOT NULL AS owned
  FROM known u CROSS JOIN items i LEFT JOIN got g ON g.customer_id = u.customer_id AND g.col = i.col
  LEFT JOIN pairs o ON o.customer_id = u.customer_id AND o.col = i.col)""",
        f"""iil AS (SELECT * FROM (SELECT exclusion, customer_id, article_id,
  row_number() OVER (PARTITION BY exclusion, customer_id ORDER BY score DESC, col) AS rank
  FROM every, (VALUES (true), (false)) e(exclusion) WHERE NOT (exclusion AND owned)) WHERE rank <= {k})"""]


SETTING = "CASE WHEN exclusion THEN 'exclusion=True' ELSE 'exclusion=False' END"

# item-item lists completed with the 7-day list, and the 14-day lists, as (week, setting, model, customer, rank, article)
TWO_MODELS = [f"""two AS (SELECT week, {SETTING} AS setting, 'item-item CF' AS model, customer_id, rank, article_id
    FROM iil JOIN cust USING (customer_id)
  UNION ALL SELECT c.week, {SETTING}, 'item-item CF', c.customer_id, p.rank, p.article_id FROM cust c JOIN pool p USING (week),
    (VALUES (true), (false)) e(exclusion) WHERE p."window" = '7d' AND p.rank <= 12 AND c.customer_id NOT IN (SELECT customer_id FROM known)
  UNION ALL SELECT week, {SETTING}, 'recency 14d', customer_id, rank, article_id FROM rl WHERE "window" = '14d')"""]
TWO_MODEL_KEYS = """SELECT setting, model FROM (VALUES ('exclusion=True'), ('exclusion=False')) x(setting),
  (VALUES ('item-item CF'), ('recency 14d')) y(model)"""


def two_models_sql() -> list[str]:
    """Scores (sc) of item-item and the 14-day list on the last event week."""
    return [*event_folds_sql(), *recency_sql([7, 14]), *item_item_sql(), *TWO_MODELS,
            *scores_sql("two", "setting, model", TWO_MODEL_KEYS)]
