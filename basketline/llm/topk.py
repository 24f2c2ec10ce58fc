"""Exact top-k search by distributed histogram selection.

Queries and candidates are cut into blocks and every pair of blocks is scored. A query's k-th best
score is found by histograms: each pair of blocks counts its scores in 4096 bins of the query's
range, from the top down to where it has k itself, the counts are added up over all blocks, and the
bin that holds the k-th score is the next, 4096 times smaller range. At width 1 the k-th score is
known exactly. A last pass keeps what is above it and, of the ties at it, as many smallest ids as
can still be wanted, and ranks them.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; a vec_id counts once, with its smallest vector; a vector shorter than another
counts as filled up with zeros; a query with fewer than k candidates gets them all; components are
floor(scale * x), and scores are exact while they fit in 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.llm.common import written

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
BIN_BITS = 12


def integer_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component as bigint."""
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    scaled = df.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"),
                                     F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("v"))
    return scaled.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    values = lists.flatten().to_numpy()
    if len(lengths) and (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def products(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Integer inner products; through float64 where every sum is exact in it."""
    dims = max((max(t["v"].combine_chunks().value_lengths().to_numpy(), default=0) for t in (left, right)), default=0)
    q, c = matrix(left["v"], int(dims)), matrix(right["v"], int(dims))
    if not dims:
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims < 2.0**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def count_bins(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """query_id, bin, n: non-empty bins of the query's range from the top, until there are `need` scores."""
    out = {"query_id": [], "bin": [], "n": []}
    if left.num_rows and right.num_rows:
        scores, ids = products(left, right), right["vec_id"].to_numpy()
        state = zip(*(left[c].to_pylist() for c in ("vec_id", "low", "shift", "need")))
        for row, (query, low, shift, need) in zip(scores, state):
            inside = row[ids != query] - low
            inside = inside[inside >= 0] >> shift
            bins, n = np.unique(inside[inside < 1 << BIN_BITS], return_counts=True)
            first = len(bins) - 1 - int(np.searchsorted(np.cumsum(n[::-1]), need)) if len(bins) else 0
            bins, n = bins[max(first, 0):], n[max(first, 0):]
            out["query_id"] += [query] * len(bins)
            out["bin"] += bins.tolist()
            out["n"] += n.tolist()
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def keep_best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """query_id, vec_id, score of all scores above the k-th and of the smallest ids among those at it."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if left.num_rows and right.num_rows:
        scores, ids = products(left, right), right["vec_id"].to_numpy()
        for row, query, low, need in zip(scores, *(left[c].to_pylist() for c in ("vec_id", "low", "need"))):
            other = ids != query
            above = np.flatnonzero(other & (row > low))
            level = np.flatnonzero(other & (row == low))
            at = np.concatenate([above, level[np.argsort(ids[level], kind="stable")[:need]]])
            out["query_id"] += [query] * len(at)
            out["vec_id"] += ids[at].tolist()
            out["score"] += row[at].tolist()
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query; `vectors` is integer_vectors()."""
    vectors = written(vectors, "vectors")
    size = F.size("v")
    spread = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = {}, {}
    for r in spread.collect():  # one row for each dimension
        lo[r["i"]], hi[r["i"]] = min(0, r["lo"]), max(0, r["hi"])
    n, n_queries, dims = vectors.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(size)).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    lo, hi = ([d[i] for i in range(dims or 0)] for d in (lo, hi))

    def bound(outer: list[int], inner: list[int]) -> Column:
        """The sum over components of x * outer where x > 0 and x * inner elsewhere."""
        sides = F.arrays_zip(F.col("v"), F.slice(F.array(*map(F.lit, outer)), F.lit(1), size).alias("p"),
                             F.slice(F.array(*map(F.lit, inner)), F.lit(1), size).alias("q"))
        return F.aggregate(sides, F.lit(0).cast("bigint"),
                           lambda s, z: s + z["v"] * F.when(z["v"] > 0, z["p"]).otherwise(z["q"]).cast("bigint"))

    widest = max(1, sum(max(abs(a), abs(b)) ** 2 for a, b in zip(lo, hi)) * 2)
    levels = -(-widest.bit_length() // BIN_BITS)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    candidates = (vectors.withColumn("cb", block).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
                  .select("qb", "cb", "vec_id", "v"))
    lowest = bound(lo, hi) if dims else F.lit(0).cast("bigint")
    queries = vectors.where(is_query).withColumn("low", lowest).withColumn("need", F.lit(k).cast("bigint"))
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))

    def paired(state: DataFrame):
        """Every block of queries with every block of candidates."""
        spread = state.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        return spread.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb"))

    for level in range(levels - 1, -1, -1):
        shift = level * BIN_BITS
        bins = paired(queries.withColumn("shift", F.lit(shift).cast("bigint"))).applyInArrow(count_bins, "query_id bigint, bin bigint, n bigint")
        # only the bins that reach the k-th score count; the highest 4096 ids of bins bound each query's rows
        bins = bins.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        ordered = F.reverse(F.array_sort(F.collect_list(F.struct("bin", "n"))))
        walk = F.aggregate(
            "bins", F.struct(F.lit(-1).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("above"), F.lit(0).cast("bigint").alias("upto")),
            lambda s, b: F.when(s["upto"] >= F.col("need"), s).otherwise(
                F.struct(b["bin"].alias("bin"), s["upto"].alias("above"), (s["upto"] + b["n"]).alias("upto"))))
        found = bins.groupBy("query_id").agg(ordered.alias("bins"))
        queries = written(
            queries.join(found, F.col("vec_id") == F.col("query_id"), "left").withColumn("at", walk)
            .select("vec_id", "v", "qb",
                    F.when(F.col("at.bin") >= 0, F.col("low") + F.shiftleft(F.col("at.bin"), shift)).otherwise(F.col("low")).alias("low"),
                    F.when(F.col("at.bin") >= 0, F.col("need") - F.col("at.above")).otherwise(F.col("need")).alias("need")), "kth")
    best = paired(queries).applyInArrow(keep_best, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
