"""Paired comparison of models over customers: differences, bootstrap intervals, weekly summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from basketline.functions.ids import dense_index
from basketline.operators.segments import with_scope
from basketline.session import materialize, spread

SUMMARY_SCOPES = ("aggregate", "3+ purchases")  # scopes of the across-week summary
DRAWS_PER_DIGEST = 8
_BUCKETS = 1 << 16
DRAWN_CELLS = 1 << 21  # weights held at once per task
MOST_GROUPS = 64  # accumulators held at once per task


def poisson_cuts() -> list[str]:
    """Cut points of a Poisson(1) draw on a 16-bit uniform, as hex text: the draw is the number of cuts <= u."""
    cuts, cumulative, term = [], 0.0, math.exp(-1.0)
    for n in range(1, 9):
        cumulative += term
        cuts.append(f"{round(cumulative * _BUCKETS):04x}")
        term /= n
    return cuts


def drawn_weights(units: Sequence[str], replicates: int, seed: int) -> np.ndarray:
    """(units, replicates) Poisson(1) weights: each md5 digest of seed, block and unit holds eight 16-bit uniforms."""
    blocks = range(math.ceil(replicates / DRAWS_PER_DIGEST))
    digests = b"".join(md5(f"{seed}|{b}|{u}".encode()).digest() for u in units for b in blocks)
    uniform = np.frombuffer(digests, ">u2").reshape(len(units), -1)[:, :replicates]
    return np.searchsorted(np.array([int(c, 16) for c in poisson_cuts()]), np.arange(_BUCKETS), "right").astype(np.uint8)[uniform]


class ReplicateSums:
    """Per group the weighted sums of each replicate over the rows seen so far."""

    def __init__(self, replicates: int, n_values: int, seed: int):
        self.replicates, self.n_values, self.seed, self.sums = replicates, n_values, seed, {}

    def add(self, groups: Sequence[tuple], units: Sequence[str], values: np.ndarray) -> None:
        """values: (rows, n) with NaN for a missing one."""
        by_group: dict[tuple, list[int]] = {}
        for i, g in enumerate(groups):
            by_group.setdefault(g, []).append(i)
        names, at = np.unique(np.asarray(units, object).astype(str), return_inverse=True)
        step = max(1, DRAWN_CELLS // self.replicates)
        for start in range(0, len(names), step):
            weights = drawn_weights(names[start:start + step], self.replicates, self.seed).astype(np.float64)
            for group, rows in by_group.items():
                own = np.array(rows)
                own = own[(at[own] >= start) & (at[own] < start + step)]
                if len(own):
                    known = ~np.isnan(values[own])
                    columns = np.concatenate([np.ones((len(own), 1)), np.where(known, values[own], 0.0), known], axis=1)
                    total = weights[at[own] - start].T @ columns
                    self.sums[group] = self.sums[group] + total if group in self.sums else total

    def rows(self) -> Iterator[tuple[tuple, np.ndarray]]:
        """(group, (replicates, 1 + n) of weights and sums, NaN where no value was drawn)."""
        for group, total in self.sums.items():
            n = self.n_values
            yield group, np.concatenate([total[:, :1], np.where(total[:, n + 1:] > 0, total[:, 1:n + 1], np.nan)], axis=1)
        self.sums = {}


def differences_wide(scores: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str],
                     metrics: Sequence[str] = ("ap", "hit")) -> DataFrame:
    """One row per (by, customer): a column per (model, metric), side by side by one aggregation."""
    names = sorted({m for pair in pairs for m in pair})
    return scores.groupBy(*by, "customer_id", "segment").agg(
        *[F.max(F.when(F.col("model") == m, F.col(x))).alias(f"{m}|{x}") for m in names for x in metrics])


def pair_differences(scores: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str],
                     metrics: Sequence[str] = ("ap", "hit")) -> DataFrame:
    """One row per (by, customer, pair, metric) with a, b and d = a - b."""
    return pair_rows(differences_wide(scores, pairs, by, metrics), pairs, by, metrics)


def pair_rows(wide: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(a).alias("a_model"), F.lit(b).alias("b_model"), F.lit(x).alias("metric"),
                 F.col(f"`{a}|{x}`").alias("a"), F.col(f"`{b}|{x}`").alias("b"))
        for a, b in pairs for x in metrics])
    return wide.select(*by, "customer_id", "segment", F.inline(cells)).withColumn("d", F.col("a") - F.col("b"))


def poisson_bootstrap(rows: DataFrame, by: Sequence[str], values: Mapping[str, Column], replicates: int,
                      seed: int = 42, unit: str = "customer_id", segment: str | None = "segment") -> DataFrame:
    """Bootstrap means with Poisson(1) weights per unit: by, [scope], replicate, one column per value.

    Every task draws the weights of its own customers in blocks and adds them up in one accumulator
    of replicates x values per group, so that a task sends a row per group and replicate whatever its
    number of customers. The weights depend on unit and replicate alone: all comparisons of a customer
    are resampled together. Scopes come from rolling the per-segment sums up.
    """
    keys = [*by, segment] if segment else list(by)
    names = list(values)
    held = spread(rows.select(*keys, F.col(unit).cast("string").alias("_unit"), *[values[n].cast("double").alias(n) for n in names]), "_unit")
    schema = T.StructType([*[held.schema[k] for k in keys], *T.StructType.fromDDL("replicate int, _w double").fields,
                           *[T.StructField(n, T.DoubleType()) for n in names]])
    arrow = to_arrow_schema(schema)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = ReplicateSums(replicates, len(names), seed)

        def out() -> Iterator[pa.RecordBatch]:
            for group, total in sums.rows():
                columns = [pa.array([g] * replicates, f.type) for g, f in zip(group, arrow)]
                columns += [pa.array(np.arange(replicates), pa.int32())]
                columns += [pa.array(c, pa.float64(), from_pandas=True) for c in total.T]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            if batch.num_rows:
                groups = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))))) if keys else [()] * batch.num_rows
                found = np.stack([batch.column(len(keys) + 1 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(names))], axis=1)
                sums.add(groups, batch.column(len(keys)).to_pylist(), found)
                if len(sums.sums) > MOST_GROUPS:
                    yield from out()
        yield from out()

    sums = held.mapInArrow(added, schema).filter("_w > 0")
    scopes = [*by, "scope"] if segment else keys
    if segment:
        sums = with_scope(sums, segment)
    sums = sums.groupBy(*scopes, "replicate").agg(F.sum("_w").alias("_w"), *[F.sum(n).alias(n) for n in names])
    return sums.select(*scopes, "replicate", *[(F.col(n) / F.col("_w")).alias(n) for n in names])


def resample_bootstrap(diffs: DataFrame, by: Sequence[str], replicates: int, seed: int = 42,
                       unit: str = "customer_id", value: str = "d") -> DataFrame:
    """(by, replicate, mean): exactly n draws with replacement out of the n units of a group.

    Units are numbered per group in sorted order; slot s of replicate b takes the unit whose number
    is a hash of (seed, b, s) modulo n.
    """
    numbered = dense_index(diffs.select(*by, unit, F.col(value).alias("_d")), [*by, unit], "_at")
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    slots = spread(numbered.join(F.broadcast(sizes), list(by)), "_at").withColumn("_slot", F.col("_at") - F.col("_from"))
    b = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("_slot").cast("string")))
    draw = F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint") % F.col("_n")
    picks = (slots.select(*by, "_n", "_slot", b.alias("replicate")).select(*by, "replicate", draw.alias("_slot"))
             .groupBy(*by, "replicate", "_slot").agg(F.count(F.lit(1)).alias("_times")))
    picked = picks.join(slots.select(*by, "_slot", "_d"), [*by, "_slot"])
    return picked.groupBy(*by, "replicate").agg(
        (F.sum(F.col("_times") * F.col("_d")) / F.sum("_times")).alias("mean"))


def intervals(means: DataFrame, by: Sequence[str]) -> DataFrame:
    """95% percentile interval of the bootstrap means."""
    return means.groupBy(*by).agg(percentile_bounds("mean").alias("_b")).select(
        *by, bound("_b", 0).alias("ci_low"), bound("_b", 1).alias("ci_high"))


def percentile_bounds(value: str) -> Column:
    return F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))


def bound(bounds: str, at: int) -> Column:
    """One bound, rounded so that summation order cannot flip the sign of a zero."""
    return F.round(F.col(bounds)[at], 12) + F.lit(0.0)


def point_differences(diffs: DataFrame, by: Sequence[str]) -> DataFrame:
    return diffs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.avg("d").alias("diff"), F.max(F.abs("d")).alias("_widest"))


def pair_intervals(wide: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], replicates: int,
                   seed: int = 42, metrics: Sequence[str] = ("ap", "hit")) -> DataFrame:
    """95% interval per (by, scope, pair, metric); all pairs share one pass of draws."""
    cells = {f"d{i}": (a, b, x) for i, (a, b, x) in enumerate((a, b, x) for a, b in pairs for x in metrics)}
    values = {n: F.col(f"`{a}|{x}`") - F.col(f"`{b}|{x}`") for n, (a, b, x) in cells.items()}
    means = poisson_bootstrap(wide, by, values, replicates, seed)
    bounds = means.groupBy(*by, "scope").agg(
        *[percentile_bounds(n).alias(n) for n in cells])
    rows = F.array(*[
        F.struct(F.lit(a).alias("a_model"), F.lit(b).alias("b_model"), F.lit(x).alias("metric"),
                 bound(n, 0).alias("ci_low"), bound(n, 1).alias("ci_high"))
        for n, (a, b, x) in cells.items()])
    return bounds.select(*by, "scope", F.inline(rows))


def significance(low: Column, high: Column) -> Column:
    return F.when(low > 0, 1).when(high < 0, -1).otherwise(0)


def verdict(identical: Column, low: Column, high: Column, a: Column, b: Column) -> Column:
    return (F.when(identical, "identical").when(low > 0, F.concat(a, F.lit(" > "), b))
            .when(high < 0, F.concat(b, F.lit(" > "), a)).otherwise("no clear difference"))


def compare_models(scores: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], replicates: int,
                   seed: int = 42, metrics: Sequence[str] = ("ap", "hit"),
                   scopes: Sequence[str] | None = None) -> DataFrame:
    """Point difference, relative gap, 95% interval, sign and verdict per (by, pair, metric, scope)."""
    keys = [*by, "a_model", "b_model", "metric", "scope"]
    wide = materialize(differences_wide(scores, pairs, by, metrics))  # both branches read it
    points = point_differences(with_scope(pair_rows(wide, pairs, by, metrics)), keys)
    bounds = pair_intervals(wide, pairs, by, replicates, seed, metrics)
    if scopes is not None:
        points = points.filter(F.col("scope").isin(*scopes))
    same = F.col("_widest") == 0
    out = points.join(bounds, keys, "left")
    low = F.when(same, 0.0).otherwise(F.col("ci_low"))
    high = F.when(same, 0.0).otherwise(F.col("ci_high"))
    return (out.withColumn("ci_low", low).withColumn("ci_high", high)
            .withColumn("rel_diff_pct", F.try_divide(100 * F.col("diff"), F.col("mean_b")))
            .withColumn("sig", significance(F.col("ci_low"), F.col("ci_high")))
            .withColumn("verdict", verdict(same, F.col("ci_low"), F.col("ci_high"), F.col("a_model"), F.col("b_model")))
            .drop("_widest"))


def summarize_weeks(weekly: DataFrame, weeks: Sequence, keys: Sequence[str]) -> DataFrame:
    """One row per comparison: a starred cell per week, mean, sd (n - 1) and weeks ahead.

    ``weekly`` holds week, rel_diff_pct and sig next to the keys.
    """
    text = F.concat(F.format_string("%+.1f", "rel_diff_pct"), F.when(F.col("sig") != 0, "*").otherwise(""))
    cell = F.when(F.col("rel_diff_pct").isNotNull(), text)
    return weekly.groupBy(*keys).agg(
        *[F.max(F.when(F.col("week") == F.lit(w), cell)).alias(f"wk {w}") for w in weeks],
        F.avg("rel_diff_pct").alias("mean"), F.stddev_samp("rel_diff_pct").alias("sd"),
        F.count_if(F.col("sig") == 1).alias("weeks_a_ahead_sig"),
        F.count_if(F.col("sig") == -1).alias("weeks_b_ahead_sig"),
        F.count_if(F.col("rel_diff_pct") > 0).alias("weeks_a_ahead_any"))


def sweep_table(comparison: DataFrame, frozen: str = "frozen") -> DataFrame:
    """Every config against the frozen one: week, config, setting, map, hit, relative gaps, sign."""
    base = comparison.filter(F.col("b_model") == frozen)
    ap = base.filter(F.col("metric") == "ap").select(
        "week", F.col("a_model").alias("config"), "setting", F.col("mean_a").alias("map"),
        F.col("rel_diff_pct").alias("rel_map_pct"), "sig")
    hit = base.filter(F.col("metric") == "hit").select(
        "week", F.col("a_model").alias("config"), "setting", F.col("mean_a").alias("hit"),
        F.col("rel_diff_pct").alias("rel_hit_pct"))
    return ap.join(hit, ["week", "config", "setting"])


def candidate_configs(sweep: DataFrame, select_weeks: Sequence, n_settings: int = 2,
                      min_gain_pct: float = 3.0) -> DataFrame:
    """A config is a candidate if, in every setting, it has all selection weeks, gains enough on
    average and is never significantly worse."""
    chosen = sweep.filter(F.col("week").isin(*select_weeks))
    per_setting = chosen.groupBy("config", "setting").agg(
        F.countDistinct("week").alias("weeks"), F.avg("rel_map_pct").alias("mean_rel"),
        F.count_if(F.col("sig") == -1).alias("worse"))
    ok = ((F.col("weeks") == len(select_weeks)) & (F.col("mean_rel") >= min_gain_pct) & (F.col("worse") == 0))
    return per_setting.groupBy("config").agg(
        (F.min(ok.cast("int")) * (F.count(F.lit(1)) == n_settings).cast("int")).cast("boolean").alias("candidate"),
        F.min("mean_rel").alias("min_mean_rel"), F.sum("worse").alias("weeks_worse"))


def best_config(results: DataFrame, config: str = "config", score: str = "map") -> DataFrame:
    """The config with the highest score; the lower name on a tie."""
    return results.orderBy(F.desc(score), F.asc(config)).limit(1)


def best_per_group(results: DataFrame, by: Sequence[str], pick: str, score: str) -> DataFrame:
    """The best ``pick`` per group; on a tie the lower name."""
    top = F.min_by(pick, F.struct((-F.col(score)).alias("s"), F.col(pick).alias("p")))
    return results.filter(F.col(score).isNotNull()).groupBy(*by).agg(top.alias(pick))


def relative_gaps(scores: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], replicates: int,
                  seed: int = 42) -> DataFrame:
    """Relative AP gap and a printed interval per scope, starred when the interval excludes 0."""
    rows = compare_models(scores, pairs, by, replicates, seed, metrics=("ap",))
    star = F.when(F.col("sig") != 0, " *").otherwise("")
    return rows.select(
        *by, "a_model", "b_model", "scope", "n", F.col("rel_diff_pct").alias("rel_pct"),
        F.concat(F.format_string("[%+.6f, %+.6f]", "ci_low", "ci_high"), star).alias("ci"))
