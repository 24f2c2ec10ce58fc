"""Gradient-boosted trees on binned features for a listwise objective, as Spark jobs over packed rows.

Features are cut into at most 255 quantile bins once, one byte a value. Whole customers lie together in
chunks of a few arrays, so that a task works on arrays and not on rows. A round adds the last tree to the
scores and takes the LambdaRank gradients of every customer's order, then grows a tree best leaf
first. What a leaf's split needs is a histogram of gradients per feature and bin: tasks add up their
rows, Spark adds up the tasks, and only the sums of the leaves in question come to the driver. The
children of all leaves that may be split next are counted in one job, so a tree takes about as many
jobs as it is deep. Gradients are whole numbers of 2^-32: sums do not depend on the order of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.functions.blocks import batch_slices
from basketline.session import materialize, spread

BINS = 255  # of known values; bin 0 is a missing one, below all others
CHUNK_ROWS = 1 << 16
UNIT = float(1 << 32)
LEAST_HESSIAN = 1e-3


def quantile_cuts(features: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending cuts of each column: bin i holds values above cut i - 2 and up to cut i - 1."""
    shares = [i / bins for i in range(1, bins)]
    row = features.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 20 * bins).alias(c) for c in columns]).first()
    return [np.unique(np.array(row[c] or [], np.float64)) for c in columns]


def binned(values: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """One row of bytes per row; NaN is missing."""
    out = np.zeros((len(values[0]) if len(values) else 0, len(values)), np.uint8)
    for i, (x, c) in enumerate(zip(values, cuts)):
        known = ~np.isnan(x)
        out[known, i] = 1 + np.searchsorted(c, x[known], "left")
    return out


def lambda_gradients(scores: np.ndarray, labels: np.ndarray, truncation: int) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, hessian) of one customer's rows, in the order that breaks ties.

    Pairs of unequal label count by the change in NDCG that swapping them makes, if the better placed
    one is in the first `truncation` positions.
    """
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    n, top = len(s), min(truncation, len(s))
    gradient, hessian = np.zeros(n), np.zeros(n)
    positive = int(min(y.sum(), truncation))
    if positive and positive < n:
        place = np.arange(n)
        discount = np.where(place < truncation, 1 / np.log2(place + 2), 0.0)
        ideal = discount[:positive].sum() if positive <= n else 1.0
        sign = np.sign(y[:top, None] - y[None, :]) * (place[None, :] > place[:top, None])
        rho = 1 / (1 + np.exp(np.minimum(sign * (s[:top, None] - s[None, :]), 700)))
        weight = np.abs(sign) * np.abs(discount[:top, None] - discount[None, :]) / ideal
        pull, curve = sign * rho * weight, rho * (1 - rho) * weight
        gradient -= pull.sum(axis=0)
        gradient[:top] += pull.sum(axis=1)
        hessian += curve.sum(axis=0)
        hessian[:top] += curve.sum(axis=1)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return gradient[back], hessian[back]


def group_gradients(scores: np.ndarray, labels: np.ndarray, sizes: np.ndarray, truncation: int) -> tuple[np.ndarray, np.ndarray]:
    """lambda_gradients() of customers that lie one after the other; those with equally many rows are worked on together."""
    starts = np.cumsum(sizes) - sizes
    gradient, hessian = np.zeros(len(scores)), np.zeros(len(scores))
    for n in np.unique(sizes[sizes > 0]).tolist():
        top = min(truncation, n)
        place = np.arange(n)
        discount = np.where(place < truncation, 1 / np.log2(place + 2), 0.0)
        ideal = np.array([discount[:k].sum() for k in range(n + 1)])
        apart = np.abs(discount[:top, None] - discount[None, :])
        later = place[None, :] > place[:top, None]
        own = starts[sizes == n]
        for part in batch_slices(len(own), 16 * top * n):  # of the pairs, several arrays are held
            at = own[part, None] + place
            positive = np.minimum(labels[at].sum(axis=1), truncation)
            teaches = (positive > 0) & (positive < n)
            at, positive = at[teaches], positive[teaches]
            at = np.take_along_axis(at, np.argsort(-scores[at], axis=1, kind="stable"), axis=1)
            s, y = scores[at], labels[at]
            sign = np.sign(y[:, :top, None] - y[:, None, :]) * later
            rho = 1 / (1 + np.exp(np.minimum(sign * (s[:, :top, None] - s[:, None, :]), 700)))
            weight = np.abs(sign) * apart / ideal[positive][:, None, None]
            pull, curve = sign * rho * weight, rho * (1 - rho) * weight
            g, h = -pull.sum(axis=1), curve.sum(axis=1)
            g[:, :top] += pull.sum(axis=2)
            h[:, :top] += curve.sum(axis=2)
            gradient[at], hessian[at] = g, h
    return gradient, hessian


@dataclass
class Tree:
    """Nodes as parallel lists; a node without children is a leaf. Rows go left up to and including the bin."""

    feature: list[int] = field(default_factory=lambda: [-1])
    upto: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, upto: int) -> tuple[int, int]:
        self.feature[node], self.upto[node] = feature, upto
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for column, empty in ((self.feature, -1), (self.upto, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column += [empty, empty]
        return self.left[node], self.right[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        feature, upto, left, right = (np.array(c) for c in (self.feature, self.upto, self.left, self.right))
        moving = np.arange(len(bins)) if left[0] >= 0 else np.empty(0, np.int64)
        while len(moving):
            at = node[moving]
            node[moving] = np.where(bins[moving, feature[at]] <= upto[at], left[at], right[at])
            moving = moving[left[node[moving]] >= 0]
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


def histograms(bins: np.ndarray, node: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, wanted: Sequence[int]) -> dict[int, np.ndarray]:
    """(features, bins, 3) sums of gradient, hessian and rows of each wanted node; gradients are whole numbers."""
    slot = np.full(max(int(node.max(initial=0)), *wanted) + 1, -1)
    slot[list(wanted)] = np.arange(len(wanted))
    rows = np.flatnonzero(slot[node] >= 0)
    first = slot[node[rows]] * (BINS + 1)
    weights = [x[rows].astype(np.float64) for x in (gradient, hessian)]
    cells = len(wanted) * (BINS + 1)
    sums = np.zeros((len(wanted), bins.shape[1], BINS + 1, 3), np.int64)
    for f, column in enumerate(np.ascontiguousarray(bins[rows].T)):
        b = first + column
        for i, x in enumerate(weights):
            sums[:, f, :, i] = np.bincount(b, x, cells).astype(np.int64).reshape(len(wanted), -1)  # below 2^53: exact
        sums[:, f, :, 2] = np.bincount(b, minlength=cells).reshape(len(wanted), -1)
    return dict(zip(wanted, sums))


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    upto: int


def best_split(sums: np.ndarray, min_rows: int) -> Split | None:
    """The split of most Newton gain; on a tie the lower feature, then the lower bin."""
    below = np.cumsum(sums, axis=1)
    total = below[:, -1:, :]
    above = total - below
    ok = (below[..., 2] >= min_rows) & (above[..., 2] >= min_rows)
    ok &= (below[..., 1] >= LEAST_HESSIAN * UNIT) & (above[..., 1] >= LEAST_HESSIAN * UNIT)

    def power(x: np.ndarray) -> np.ndarray:
        return x[..., 0].astype(float) ** 2 / np.maximum(x[..., 1].astype(float), 1.0) / UNIT

    gain = np.where(ok, power(below) + power(above) - power(total), -np.inf)
    feature, upto = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return Split(float(gain[feature, upto]), int(feature), int(upto)) if gain[feature, upto] > 1e-12 else None


def grow(count, leaves: int, min_rows: int) -> tuple[Tree, list[tuple[int, float]]]:
    """A tree of at most `leaves` leaves, and (feature, gain) of its splits.

    count(tree, nodes) gives the histograms of nodes of a tree whose leaves they are. The tree that is
    counted is grown ahead of the one that is kept: all leaves that may be split have their children counted together.
    """
    ahead = Tree()
    sums = count(ahead, [0])
    splits = {0: best_split(sums[0], min_rows)}
    kept, gains = {0}, []
    while len(kept) < leaves:
        able = [n for n in kept if splits[n]]
        if not able:
            break
        best = max(able, key=lambda n: (splits[n].gain, -n))
        if ahead.left[best] < 0:
            room = leaves - len(kept)
            new = []
            for n in sorted(able, key=lambda n: (-splits[n].gain, n))[:room]:
                if ahead.left[n] < 0:
                    new += ahead.split(n, splits[n].feature, splits[n].upto)
            found = count(ahead, new)
            sums |= found
            splits |= {n: best_split(found[n], min_rows) for n in new}
        gains.append((splits[best].feature, splits[best].gain))
        kept = kept - {best} | {ahead.left[best], ahead.right[best]}
    tree, todo = Tree(), [(0, 0)]
    while todo:
        n, own = todo.pop()
        if n in kept:
            g, h, _ = sums[n][0].sum(axis=0)
            tree.value[own] = float(g) / max(float(h), 1.0)
        else:
            todo += zip((ahead.left[n], ahead.right[n]), tree.split(own, ahead.feature[n], ahead.upto[n]))
    return tree, gains


CHUNK = "bins binary, labels binary, sizes binary, scores binary"


def chunks(rows: DataFrame, columns: Sequence[str], cuts: Sequence[np.ndarray], group: Sequence[str], tie: str) -> DataFrame:
    """CHUNK: rows of whole groups as arrays, sorted by `tie` within a group."""
    n_keys = len(group)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last, open_rows = None, 0

        def chunk() -> pa.RecordBatch:
            bins, labels, starts = (np.concatenate(x) for x in zip(*held))
            sizes = np.diff(np.append(np.flatnonzero(starts), len(starts)))
            data = [bins.tobytes(), labels.tobytes(), sizes.astype(np.int32).tobytes(), np.zeros(len(labels)).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], ["bins", "labels", "sizes", "scores"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
            starts = np.array([a != b for a, b in zip(keys, [last, *keys[:-1]])])
            values = [batch.column(n_keys + 1 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(columns))]
            bins, labels = binned(values, cuts), batch.column(n_keys).to_numpy(zero_copy_only=False).astype(np.uint8)
            last, at = keys[-1], 0
            for start in np.flatnonzero(starts):
                if open_rows + start - at >= CHUNK_ROWS:  # a chunk ends where a group starts
                    held.append((bins[at:start], labels[at:start], starts[at:start]))
                    yield chunk()
                    held, open_rows, at = [], 0, int(start)
            held.append((bins[at:], labels[at:], starts[at:]))
            open_rows += len(labels) - at
        if held:
            yield chunk()

    flat = spread(rows, *group).sortWithinPartitions(*group, tie)
    return flat.select(*group, "label", *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(pack, CHUNK)


def _arrays(batch: pa.RecordBatch, n_features: int) -> Iterator[tuple[dict[str, pa.Scalar], dict[str, np.ndarray]]]:
    kinds = {"bins": np.uint8, "labels": np.uint8, "sizes": np.int32, "scores": np.float64, "gradient": np.int64, "hessian": np.int64}
    for row in range(batch.num_rows):
        cells = {c: batch.column(c)[row] for c in batch.schema.names}
        arrays = {c: np.frombuffer(v.as_buffer(), kinds[c]) for c, v in cells.items()}
        arrays["bins"] = arrays["bins"].reshape(-1, n_features)
        yield cells, arrays


def graded(held: DataFrame, tree: Tree | None, learning_rate: float, truncation: int, n_features: int) -> DataFrame:
    """Chunks with the tree added to their scores, and the gradients of the new order."""
    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, a in _arrays(batch, n_features):
                scores = a["scores"] if tree is None else a["scores"] + learning_rate * tree.values(a["bins"])
                g, h = group_gradients(scores, a["labels"].astype(np.int64), a["sizes"].astype(np.int64), truncation)
                out = np.stack([np.rint(g * UNIT), np.rint(h * UNIT)]).astype(np.int64)
                data = [cells["bins"], cells["labels"], cells["sizes"], scores.tobytes(), out[0].tobytes(), out[1].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([d if isinstance(d, bytes) else d.as_py()], pa.binary()) for d in data],
                                                 ["bins", "labels", "sizes", "scores", "gradient", "hessian"])

    return held.select("bins", "labels", "sizes", "scores").mapInArrow(grade, CHUNK + ", gradient binary, hessian binary")


def counter(rows: DataFrame, n_features: int):
    """count(tree, nodes) over graded chunks: histograms added up by Spark."""
    def count(tree: Tree, nodes: Sequence[int]) -> dict[int, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {n: np.zeros((n_features, BINS + 1, 3), np.int64) for n in nodes}
            for batch in batches:
                for _, a in _arrays(batch, n_features):
                    for n, sums in histograms(a["bins"], tree.leaves(a["bins"]), a["gradient"], a["hessian"], nodes).items():
                        total[n] += sums
            for n, sums in total.items():
                feature, b = np.nonzero(sums[..., 2])
                g, h, rows_ = sums[feature, b].T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), n)), pa.array(feature), pa.array(b), pa.array(g), pa.array(h), pa.array(rows_)],
                                                 ["node", "feature", "bin", "g", "h", "n"])

        parts = rows.select("bins", "gradient", "hessian").mapInArrow(part, "node bigint, feature bigint, bin bigint, g bigint, h bigint, n bigint")
        out = {n: np.zeros((n_features, BINS + 1, 3), np.int64) for n in nodes}
        # at most leaves x features x bins rows
        table = parts.groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
        columns = [table[c].to_numpy() for c in table.schema.names]
        for n in nodes:
            own = columns[0] == n
            out[n][columns[1][own], columns[2][own]] = np.stack([c[own] for c in columns[3:]], axis=1)
        return out

    return count


def boost(rows: DataFrame, columns: Sequence[str], cuts: Sequence[np.ndarray], group: Sequence[str], tie: str, rounds: int, learning_rate: float,
          leaves: int, min_rows: int, truncation: int, checkpoint_every: int) -> tuple[list[Tree], list[float]]:
    """Trees, and each feature's share of the gain; rows hold group, tie, label and the columns.

    Graded chunks are kept for their round; every few rounds they are checkpointed, so that a lost
    executor repeats those rounds at most.
    """
    n, trees, gain = len(columns), [], [0.0] * len(columns)
    held = materialize(chunks(rows, columns, cuts, group, tie))
    before, tree = None, None
    for i in range(rounds):
        now = graded(held, tree, learning_rate, truncation, n).persist(StorageLevel.MEMORY_AND_DISK)
        tree, gains = grow(counter(now, n), leaves, min_rows)
        for f, g in gains:
            gain[f] += g
        trees.append(tree)
        if before is not None:
            before.unpersist()
        before = now
        held = now
        if (i + 1) % checkpoint_every == 0 and i + 1 < rounds:
            held = materialize(now)
            before.unpersist()
            before = None
    if before is not None:
        before.unpersist()
    whole = math.fsum(gain) or 1.0
    return trees, [g / whole for g in gain]
