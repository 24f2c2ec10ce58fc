"""Implicit-feedback ALS on purchase counts, its training loss and its lists.

Alternating least squares in blocks: a block of rows of one side asks once for the factors of the other
side's rows it meets, and solves its rows against the shared Gram matrix. A row with very many pairs is
cut into parts that lie in different blocks and add up their normal equations. Each half of a sweep
is a table, so a fit starts from given factors as well as from random ones, and the loss of
every sweep is a by-product of the fit.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.functions.ids import dense_index
from basketline.operators.factors import gram, score_top_k
from basketline.operators.itemitem import weighted_interactions
from basketline.session import materialize

# The frozen configuration and the one-knob-at-a-time grid around it.
FROZEN = {"factors": 150, "regularization": 0.1, "alpha": 15.0, "iterations": 40}
GRID = {
    "alpha8": {**FROZEN, "alpha": 8.0},
    "alpha25": {**FROZEN, "alpha": 25.0},
    "reg0.03": {**FROZEN, "regularization": 0.03},
    "reg0.3": {**FROZEN, "regularization": 0.3},
    "f100": {**FROZEN, "factors": 100},
    "f200": {**FROZEN, "factors": 200},
}
SEED = 42


BLOCK_PAIRS = 1 << 16
ROW_PAIRS = 1 << 14  # of a row in one block


@dataclass(frozen=True)
class Side:
    """One side of the matrix in blocks, and the rows of the other side that each block asks for."""

    rows: DataFrame    # block, idx, whole, others, weights
    routes: DataFrame  # block, other
    split: bool        # whether any row lies in several blocks


@dataclass(frozen=True)
class Interactions:
    """Count-weighted pairs under dense row and column numbers; the blocks of both sides are made once."""

    pairs: DataFrame       # customer_idx, article_idx, weight
    customer_ids: DataFrame  # customer_id, customer_idx
    article_ids: DataFrame   # article_id, article_idx
    lock: threading.RLock = field(default_factory=threading.RLock, compare=False, repr=False)

    @cached_property
    def sizes(self) -> tuple[int, int, float, int]:
        """Customers, articles, their summed weights and the number of pairs."""
        with self.lock:
            total, n = self.pairs.agg(F.sum(F.col("weight").cast("double")), F.count(F.lit(1))).first()
            return self.customer_ids.count(), self.article_ids.count(), total or 0.0, n

    @cached_property
    def customers(self) -> Side:
        with self.lock:
            return self._side("customer_idx", "article_idx")

    @cached_property
    def articles(self) -> Side:
        with self.lock:
            return self._side("article_idx", "customer_idx")

    def _side(self, idx: str, other: str) -> Side:
        pairs = self.pairs.select(F.col(idx).alias("idx"), F.col(other).alias("other"), "weight")
        counts = pairs.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
        n_blocks = max(1, -(-self.sizes[3] // BLOCK_PAIRS))
        part = F.pmod(F.xxhash64("other"), F.ceil(F.col("n") / ROW_PAIRS))
        placed = pairs.join(counts, "idx").select("idx", "other", "weight", part.alias("part"), (F.col("n") <= ROW_PAIRS).alias("whole"))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("idx", "part"), F.lit(n_blocks)))
        # in one order whatever the shuffle did, so that a seed gives one result
        packed = F.sort_array(F.collect_list(F.struct("other", "weight")))
        rows = placed.groupBy("block", "idx", "part", "whole").agg(packed.alias("x"))
        rows = materialize(rows.select("block", "idx", "whole", F.col("x.other").alias("others"), F.col("x.weight").alias("weights")))
        routes = materialize(rows.select("block", F.explode("others").alias("other")).distinct())
        return Side(rows, routes, not rows.filter(~F.col("whole")).isEmpty())


def index_interactions(history: DataFrame) -> Interactions:
    weights = materialize(weighted_interactions(history))
    users = materialize(dense_index(weights.select("customer_id").distinct(), ["customer_id"], "customer_idx"))
    items = materialize(dense_index(weights.select("article_id").distinct(), ["article_id"], "article_idx"))
    pairs = (weights.join(users, "customer_id").join(items, "article_id")
             .select("customer_idx", "article_idx", F.col("weight").cast("float").alias("weight")))
    return Interactions(materialize(pairs), users, items)


@dataclass(frozen=True)
class FittedALS:
    users: DataFrame  # idx, features
    items: DataFrame  # idx, features
    data: Interactions
    config: Mapping[str, float]
    losses: Sequence[tuple[int, float]] = ()  # after each sweep

    @property
    def user_factors(self) -> DataFrame:
        """(customer_id, features)"""
        return (self.users.select(F.col("idx").alias("customer_idx"), "features").join(self.data.customer_ids.hint("merge"), "customer_idx")
                .select("customer_id", "features"))

    @property
    def item_factors(self) -> DataFrame:
        """(article_id, features)"""
        return (self.items.select(F.col("idx").alias("article_idx"), "features").join(self.data.article_ids, "article_idx")
                .select("article_id", "features"))


def random_factors(ids: DataFrame, idx: str, rank: int, seed: int) -> DataFrame:
    """idx, features: numbers between -1 and 1 over the root of the rank, the same wherever a row lies."""
    unit = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda j: (
        F.pmod(F.xxhash64(F.lit(seed), F.col(idx), j), F.lit(1 << 24)).cast("double") / (1 << 23) - 1) / rank ** 0.5)
    return ids.select(F.col(idx).alias("idx"), unit.alias("features"))


def matrix_of(factors: DataFrame, rank: int) -> np.ndarray:
    """The Gram matrix of a factor table: rank x rank numbers."""
    out = np.zeros((rank, rank))
    for r in gram(factors).collect():
        out[r["i"], r["j"]] = r["value"]
    return out


def least_squares(rows: pa.Table, asked: pa.Table, alpha: float, rank: int):
    """(idx, sum of w v v', sum of c v, sum of c) of each row; c = 1 + alpha x weight and w = c - 1."""
    if not rows.num_rows:
        return
    ids = asked["other"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, factors = ids[order], asked["features"].combine_chunks().flatten().to_numpy().reshape(-1, rank)[order]
    for idx, others, weights in zip(rows["idx"].to_pylist(), rows["others"], rows["weights"]):
        v = factors[np.searchsorted(ids, others.values.to_numpy())]
        w = alpha * weights.values.to_numpy().astype(np.float64)
        yield idx, (v * w[:, None]).T @ v, (1 + w) @ v, float((1 + w).sum())


SOLVED = "idx bigint, features array<double>, observed double"
PARTS = "idx bigint, a array<double>, b array<double>, c double"


def solved(side: Side, other: DataFrame, base: np.ndarray, alpha: float) -> DataFrame:
    """idx, features, observed: each row's least-squares factors given the other side's, base added to its normal matrix.

    observed is the sum of c (1 - p)^2 - p^2 over the row's pairs, p their scores with the new factors.
    """
    rank = len(base)

    def finish(found) -> pa.Table:
        out: dict[str, list] = {"idx": [], "features": [], "observed": []}
        for idx, a, b, c in found:
            x = np.linalg.solve(a + base, b)
            out["idx"].append(idx)
            out["features"].append(x)
            out["observed"].append(c - 2 * float(b @ x) + float(x @ a @ x))
        return pa.table({"idx": pa.array(out["idx"], pa.int64()), "features": pa.array(out["features"], pa.list_(pa.float64())),
                         "observed": pa.array(out["observed"], pa.float64())})

    def whole(rows: pa.Table, asked: pa.Table) -> pa.Table:
        return finish(least_squares(rows, asked, alpha, rank))

    def part(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = list(least_squares(rows, asked, alpha, rank))
        lists = pa.list_(pa.float64())
        return pa.table({"idx": pa.array([f[0] for f in found], pa.int64()), "a": pa.array([f[1].ravel() for f in found], lists),
                         "b": pa.array([f[2] for f in found], lists), "c": pa.array([f[3] for f in found], pa.float64())})

    def merged(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("c")
        a, b = (sum(x.values.to_numpy() for x in parts[n]) for n in ("a", "b"))
        return finish([(parts["idx"][0].as_py(), a.reshape(rank, rank), b, sum(parts["c"].to_pylist()))])

    def blocks(whole_rows: bool):
        # both sides grow with the log, and a fit has two such joins a sweep: none of them goes through the driver
        asked = side.routes.join(other.select(F.col("idx").alias("other"), "features").hint("merge"), "other")
        return side.rows.filter(F.col("whole") == whole_rows).groupBy("block").cogroup(asked.withColumnRenamed("block", "by").groupBy("by"))

    out = blocks(True).applyInArrow(whole, SOLVED)
    if side.split:
        out = out.unionByName(blocks(False).applyInArrow(part, PARTS).groupBy("idx").applyInArrow(merged, SOLVED))
    return out


def fit_als(data: Interactions, config: Mapping[str, float], seed: int = SEED, start: FittedALS | None = None) -> FittedALS:
    """`iterations` sweeps from random factors, or on from a fit with the same data and number of factors.

    The objective is sum of c (p - u v)^2 over all pairs, bought or not, plus regularization x the squared
    norms; the loss is that divided by the sum of c.
    """
    rank, alpha, reg = int(config["factors"]), float(config["alpha"]), float(config["regularization"])
    items = start.items if start else random_factors(data.article_ids, "article_idx", rank, seed)
    users, losses = start.users if start else None, list(start.losses) if start else []
    n_users, n_items, weight, _ = data.sizes
    inner = matrix_of(items, rank)
    for _ in range(int(config["iterations"])):
        users = materialize(solved(data.customers, items, inner + reg * np.eye(rank), alpha))
        outer = matrix_of(users, rank)
        items = materialize(solved(data.articles, users, outer + reg * np.eye(rank), alpha))
        inner = matrix_of(items, rank)
        observed = items.agg(F.sum("observed")).first()[0] or 0.0
        total = observed + float((outer * inner).sum()) + reg * float(np.trace(outer) + np.trace(inner))
        losses.append((len(losses) + 1, total / (n_users * n_items + alpha * weight) if n_users else 0.0))
    if users is None:
        users = materialize(solved(data.customers, items, inner + reg * np.eye(rank), alpha))
    return FittedALS(users.select("idx", "features"), items.select("idx", "features"), data, dict(config), tuple(losses))


def recommend(fitted: FittedALS, customers: DataFrame, history: DataFrame, k: int = 12,
              modes: Sequence[str] = ("repurchase", "discover")) -> DataFrame:
    """(customer_id, mode, items, scores) for customers with a factor row; owned articles are masked inside the score block."""
    return recommend_from(fitted.user_factors, fitted.item_factors, customers, history, k, modes)


def recommend_from(user_factors: DataFrame, item_factors: DataFrame, customers: DataFrame, history: DataFrame, k: int = 12,
                   modes: Sequence[str] = ("repurchase", "discover")) -> DataFrame:
    """recommend() from factor tables alone, such as a loaded artifact's."""
    wanted = customers.select("customer_id").distinct()
    users = user_factors.join(wanted.hint("merge"), "customer_id", "left_semi").withColumnRenamed("customer_id", "user_id")
    items = item_factors.withColumnRenamed("article_id", "item_id")
    owned = (history.select(F.col("customer_id").alias("user_id"), F.col("article_id").alias("item_id"))
             .join(wanted.withColumnRenamed("customer_id", "user_id").hint("merge"), "user_id", "left_semi").distinct())
    return score_top_k(users, items, k, owned, modes).withColumnRenamed("user_id", "customer_id")


def top_n(fitted: FittedALS, customers: DataFrame, n: int) -> DataFrame:
    """(customer_id, article_id, score, rank) of the n best articles, bought ones allowed."""
    users = fitted.user_factors.join(customers.select("customer_id").distinct(), "customer_id", "left_semi")
    lists = score_top_k(users.withColumnRenamed("customer_id", "user_id"), fitted.item_factors.withColumnRenamed("article_id", "item_id"), n)
    rows = lists.select(F.col("user_id").alias("customer_id"), F.posexplode(F.arrays_zip("items", "scores")).alias("pos", "x"))
    return rows.select("customer_id", F.col("x.items").alias("article_id"), F.col("x.scores").alias("score"), (F.col("pos") + 1).alias("rank"))


def direct_loss(fitted: FittedALS) -> DataFrame:
    """One row: the loss from the factor tables alone, by joins of the bought pairs and the two Gram matrices.

    The second route to what a fit reports; pairs that were not bought enter through the Gram matrices.
    """
    users, items = (t.select(F.col("idx").alias(i), F.col("features").alias(f)) for t, i, f in (
        (fitted.users, "customer_idx", "u"), (fitted.items, "article_idx", "v")))
    score = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    seen = fitted.data.pairs.join(users, "customer_idx").join(items, "article_idx").withColumn("p", score)
    confidence = 1 + F.lit(float(fitted.config["alpha"])) * F.col("weight").cast("double")
    observed = seen.agg(F.sum(confidence * (1 - F.col("p")) ** 2 - F.col("p") ** 2).alias("observed"))
    both = gram(fitted.users).withColumnRenamed("value", "g").join(gram(fitted.items).withColumnRenamed("value", "h"), ["i", "j"])
    norms = F.sum(F.when(F.col("i") == F.col("j"), F.col("g") + F.col("h")))
    rest = both.agg((F.sum(F.col("g") * F.col("h")) + F.lit(float(fitted.config["regularization"])) * norms).alias("rest"))
    n_users, n_items, weight, _ = fitted.data.sizes
    total = float(n_users) * n_items + float(fitted.config["alpha"]) * weight
    return observed.crossJoin(F.broadcast(rest)).select(((F.col("observed") + F.col("rest")) / F.lit(total)).alias("loss"))


def loss_curve(data: Interactions, config: Mapping[str, float], iterations: Sequence[int], seed: int = SEED) -> DataFrame:
    """(iteration, loss) out of one fit."""
    fitted = fit_als(data, {**config, "iterations": max(iterations)}, seed)
    return data.pairs.sparkSession.createDataFrame([(n, x) for n, x in fitted.losses if n in iterations], "iteration int, loss double")
