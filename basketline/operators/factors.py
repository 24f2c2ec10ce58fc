"""Top-k by dot product from saved factor tables, with and without already-bought articles.

Articles are packed into blocks of falling norm. A block of customers is held by one task, which
streams the article blocks past it and keeps a running top k: no score of a block can exceed the
product of the norms, so once that is below everybody's k-th score the block, and all after it, is
skipped. Once there are k scores, a block is multiplied in single precision, once for both modes, and
only pairs that may pass the k-th score within the error of that are scored in double precision.
Neither side is collected or broadcast; one task holds one block of each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.functions import blocks
from basketline.functions.ids import dense_index

REPURCHASE, DISCOVER = "repurchase", "discover"
MODES = (REPURCHASE, DISCOVER)
USER_BLOCK, ITEM_BLOCK = 32768, 4096
ITEM_PIECE = 4  # articles in a row of the stream: Spark hands thousands of rows to Python at once
USERS, ITEMS = 0, 1  # kinds of rows in a block's stream, in their order


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


class RunningTop:
    """The k best articles of each customer of a block over the article blocks seen so far."""

    def __init__(self, factors: np.ndarray, owned: Sequence[np.ndarray] | None, k: int):
        n = len(factors)
        self.factors, self.owned, self.k, self.seen, self.skipped = factors, owned, k, 0, 0
        self.norms = np.sqrt((factors ** 2).sum(axis=1))
        self.ids, self.scores = np.zeros((n, 0), np.int64), np.zeros((n, 0))
        self._owned_rows = self._owned_ids = None

    def add(self, ids: np.ndarray, matrix: np.ndarray, largest_norm: float) -> None:
        """A block with ascending ids; blocks come by falling norm."""
        add_block([self], ids, matrix, largest_norm)

    def candidates(self, largest_norm: float) -> np.ndarray:
        """Rows that a block may change."""
        if self.scores.shape[1] < self.k:
            return np.arange(len(self.factors))
        # scores are rounded to 9 places, and an equal score with a lower id still counts
        return np.flatnonzero(self.norms * largest_norm * (1 + 1e-12) + 1e-9 >= self.scores[:, -1])

    def add_whole(self, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Every score of `rows` with a block."""
        width = min(self.k, len(ids))
        best_ids, best = np.zeros((len(self.factors), width), np.int64), np.full((len(self.factors), width), -np.inf)
        for at in blocks.batch_slices(len(rows), 4 * len(ids)):  # of the scores, several arrays are held
            scores = self.factors[rows[at]] @ matrix.T
            np.round(scores, 9, out=scores)
            if self.owned is not None:
                for i, row in enumerate(rows[at]):
                    own = self.owned[row]
                    place = np.searchsorted(ids, own)
                    place = place[(place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == own)]
                    scores[i, place] = -np.inf
            columns, values = blocks.top_columns(scores, width)
            best_ids[rows[at]], best[rows[at]] = ids[columns], values
        ids, scores = np.concatenate([self.ids, best_ids], axis=1), np.concatenate([self.scores, best], axis=1)
        order = np.argsort(ids, axis=1, kind="stable")
        ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :self.k]
        self.ids, self.scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)

    def add_pairs(self, rows: np.ndarray, columns: np.ndarray, ids: np.ndarray, matrix: np.ndarray, taken: np.ndarray) -> None:
        """Scores of single pairs, `taken` tells which are owned; k scores of every row are known."""
        if self.owned is not None:
            rows, columns = rows[~taken], columns[~taken]
        scores = np.empty(len(rows))
        for at in blocks.batch_slices(len(rows), 4 * matrix.shape[1]):
            scores[at] = np.einsum("ij,ij->i", self.factors[rows[at]], matrix[columns[at]])
        np.round(scores, 9, out=scores)
        new = scores >= self.scores[rows, -1]
        rows, columns, scores = rows[new], columns[new], scores[new]
        changed = np.unique(rows)
        rows = np.concatenate([np.repeat(changed, self.k), rows])
        found = np.concatenate([self.ids[changed].ravel(), ids[columns]])
        scores = np.concatenate([self.scores[changed].ravel(), scores])
        order = np.lexsort((found, -scores, rows))
        starts = np.searchsorted(rows[order], changed)
        order = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.ids[changed], self.scores[changed] = found[order].reshape(-1, self.k), scores[order].reshape(-1, self.k)

    def owned_of(self, ids: np.ndarray) -> np.ndarray:
        """Which cells of a block are owned: row * len(ids) + column, ascending."""
        if self._owned_rows is None:
            self._owned_rows = np.repeat(np.arange(len(self.owned)), [len(o) for o in self.owned])
            self._owned_ids = np.concatenate([*self.owned, np.empty(0, np.int64)])
        place = np.minimum(np.searchsorted(ids, self._owned_ids), len(ids) - 1)
        met = ids[place] == self._owned_ids
        return np.sort(self._owned_rows[met] * len(ids) + place[met])

    def lists_between(self, first: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for ids, scores in zip(self.ids[first:end], self.scores[first:end]):
            known = np.isfinite(scores)
            yield ids[known], scores[known]


def add_block(tops: Sequence[RunningTop], ids: np.ndarray, matrix: np.ndarray, largest_norm: float) -> None:
    """A block with ascending ids for several lists of the same customers, multiplied once."""
    first, wanted = tops[0], [top.candidates(largest_norm) for top in tops]
    for top, rows in zip(tops, wanted):
        top.seen += 1
        top.skipped += not len(rows)
    # |u . v| in single precision is off by less than that: the rounding of both sides, of each product and of each sum
    error = (matrix.shape[1] + 4) * 2.0 ** -23 * first.norms * largest_norm + matrix.shape[1] * 1e-30
    single = all(top.scores.shape[1] == top.k for top in tops) and np.abs(matrix).max(initial=0) < 1e15 and np.abs(first.factors).max(initial=0) < 1e15
    if not single:
        for top, rows in zip(tops, wanted):
            if len(rows):
                top.add_whole(rows, ids, matrix)
        return
    limits = [np.full(len(first.factors), np.inf) for _ in tops]
    for top, rows, limit in zip(tops, wanted, limits):
        last = top.scores[rows, -1]
        limit[rows] = last - 2e-9 - error[rows] - np.abs(np.where(np.isfinite(last), last, 0)) * 2.0 ** -22
    least = np.minimum.reduce(limits)
    rows = np.flatnonzero(least < np.inf)
    matrix_32, taken = matrix.astype(np.float32).T, None
    for at in blocks.batch_slices(len(rows), len(ids)):
        some = rows[at]
        scores = first.factors[some].astype(np.float32) @ matrix_32
        cells = np.flatnonzero(scores >= least[some].astype(np.float32)[:, None])
        if not len(cells):
            continue
        if len(cells) > scores.size // 16 + 64 * len(some):  # most scores are about equal
            for top, mine in zip(tops, wanted):
                mine = np.intersect1d(mine, some)
                if len(mine):
                    top.add_whole(mine, ids, matrix)
            continue
        values, which, columns = scores.ravel()[cells].astype(np.float64), some[cells // len(ids)], cells % len(ids)
        for top, limit in zip(tops, limits):
            # the limit in single precision may lie a rounding above; its slack covers that
            mine = values >= limit[which].astype(np.float32)
            owned = np.zeros(np.count_nonzero(mine), bool)
            if top.owned is not None:
                taken = top.owned_of(ids) if taken is None else taken
                code = which[mine] * len(ids) + columns[mine]
                place = np.minimum(np.searchsorted(taken, code), max(0, len(taken) - 1))
                owned = taken[place] == code if len(taken) else owned
            top.add_pairs(which[mine], columns[mine], ids, matrix, owned)


def item_blocks(items: DataFrame) -> DataFrame:
    """ib, piece, ids, vectors, norm: articles in blocks of falling norm, each in pieces of ITEM_PIECE."""
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    known = items.select("item_id", F.col("features").cast("array<double>").alias("features"), norm.alias("norm"))
    placed = dense_index(known.withColumn("less", -F.col("norm")), ["less", "item_id"], "at")
    packed = F.sort_array(F.collect_list(F.struct("item_id", "features")))
    return (placed.groupBy(F.expr(f"at div {ITEM_BLOCK}").alias("ib"), F.expr(f"at div {ITEM_PIECE}").alias("piece"))
            .agg(packed.alias("x"), F.max("norm").alias("norm"))
            .select("ib", "piece", F.col("x.item_id").alias("ids"), F.col("x.features").alias("vectors"), "norm"))


def score_top_k(users: DataFrame, items: DataFrame, k: int, owned: DataFrame | None = None, modes: Sequence[str] = (REPURCHASE,)) -> DataFrame:
    """(user_id, mode, items, scores), best first; ties go to the lower id.

    users: (user_id, features); items: (item_id, features); owned: distinct (user_id, item_id).
    """
    modes = tuple(m for m in MODES if m in modes)
    if DISCOVER in modes and owned is None:
        raise ValueError("discover mode needs the owned pairs")
    n_users = users.count()
    n_blocks = max(1, -(-n_users // USER_BLOCK), min(users.sparkSession.sparkContext.defaultParallelism, n_users // 256))
    block = F.pmod(F.xxhash64("user_id"), F.lit(n_blocks))
    people = users.select("user_id", F.col("features").cast("array<double>").alias("features"))
    if owned is not None:
        held = owned.groupBy("user_id").agg(F.sort_array(F.collect_list(F.col("item_id").cast("bigint"))).alias("owned"))
        people = people.join(held.hint("merge"), "user_id", "left")
    else:
        people = people.withColumn("owned", F.lit(None).cast("array<bigint>"))
    empty = {"user_id": people.schema["user_id"].dataType, "features": "array<double>", "owned": "array<bigint>", "ib": "bigint",
             "ids": "array<bigint>", "vectors": "array<array<double>>", "norm": "double"}

    def row(kind: int, rows: DataFrame, block) -> DataFrame:
        return rows.select(block.alias("block"), F.lit(kind).alias("kind"),
                           *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()])

    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint")))
    stream = row(USERS, people, block).unionByName(row(ITEMS, item_blocks(items).withColumn("block", copies), F.col("block")))
    stream = stream.repartitionById(n_blocks, F.col("block").cast("int")).sortWithinPartitions("block", "kind", "ib")  # a task for each block
    key = people.schema["user_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, people, tops = None, [], {}
        last, held = None, []  # an article block, and what has come of it

        def finished() -> Iterator[pa.RecordBatch]:
            names = pa.concat_arrays([p.column("user_id") for p in people])
            for mode, top in tops.items():
                for at in range(0, len(names), 1024):
                    lists = list(top.lists_between(at, at + 1024))
                    yield pa.RecordBatch.from_arrays(
                        [names.slice(at, 1024), pa.array([mode] * len(lists)), pa.array([i for i, _ in lists], pa.list_(pa.int64())),
                         pa.array([s for _, s in lists], pa.list_(pa.float64()))], ["user_id", "mode", "items", "scores"])

        def begin() -> dict[str, RunningTop]:
            vectors = np.concatenate([_matrix(p.column("features")) for p in people])
            own = [np.asarray(o or [], np.int64) for p in people for o in p.column("owned").to_pylist()]
            return {m: RunningTop(vectors, own if m == DISCOVER else None, k) for m in modes}

        def add_held() -> None:
            nonlocal held
            if held:
                ids, matrix = (np.concatenate(x) for x in list(zip(*held))[:2])
                order = np.argsort(ids, kind="stable")
                add_block(list(tops.values()), ids[order], matrix[order], max(norm for _, _, norm in held))
            held = []

        for batch in batches:
            which, kinds, block_of = batch.column("block").to_numpy(), batch.column("kind").to_numpy(), batch.column("ib").fill_null(-1).to_numpy()
            cuts = np.flatnonzero((which[1:] != which[:-1]) | (kinds[1:] != kinds[:-1]) | (block_of[1:] != block_of[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if which[lo] != now:
                    add_held()
                    if people:
                        tops = tops or begin()
                        yield from finished()
                    now, people, tops = which[lo], [], {}
                if kinds[lo] == USERS:
                    people.append(part)
                elif people:
                    tops = tops or begin()
                    if block_of[lo] != last:
                        add_held()
                    last = block_of[lo]
                    held.append((part.column("ids").flatten().to_numpy(), _matrix(part.column("vectors").flatten()), max(part.column("norm").to_pylist())))
        add_held()
        if people:
            tops = tops or begin()
            yield from finished()

    return stream.mapInArrow(score, f"user_id {key}, mode string, items array<bigint>, scores array<double>")


def gram(factors: DataFrame) -> DataFrame:
    """(i, j, value): the factor table's rank x rank Gram matrix from per-task partial products, added up in one order."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("features"))
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.indices(total.shape)
            task = np.full(total.size, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i.ravel().astype(np.int32), j.ravel().astype(np.int32), task, total.ravel())],
                                             ["i", "j", "task", "value"])

    parts = factors.select("features").mapInArrow(partial, "i int, j int, task int, value double")
    in_order = F.sort_array(F.collect_list(F.struct("task", "value")))
    return parts.groupBy("i", "j").agg(F.aggregate(in_order, F.lit(0.0), lambda s, x: s + x["value"]).alias("value"))
