"""NumPy helpers that run inside Spark tasks on one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CELLS = 4_000_000  # score cells held at once per task


def batch_slices(n_rows: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, width))
    for start in range(0, n_rows, step):
        yield slice(start, min(start + step, n_rows))


def top_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers and scores of the k best per row, best first, the lower column on a tie."""
    k = min(k, scores.shape[1])
    if k == 0:
        return np.empty((len(scores), 0), int), np.empty((len(scores), 0))
    part = np.sort(np.argpartition(-scores, k - 1, axis=1)[:, :k], axis=1)
    values = np.take_along_axis(scores, part, axis=1)
    lowest = values.min(axis=1, keepdims=True)
    # a tie across the cut: argpartition may have kept the wrong columns
    split = (scores == lowest).sum(axis=1) > (values == lowest).sum(axis=1)
    for row in np.flatnonzero(split):
        part[row] = np.sort(np.argsort(-scores[row], kind="stable")[:k])
    values = np.take_along_axis(scores, part, axis=1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1), np.take_along_axis(values, order, axis=1)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in their order; sorted, which is faster here than NumPy's hashing of integers."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[:len(values)]]


def pair_counts(halves: Iterable[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, how often) of the column pairs a <= b with a in a slice of a sorted basket and b in the rest from there, `cells` at once.

    A pair may come several times; the counts are to be added up.
    """
    waiting: list[np.ndarray] = []
    size = 0

    def counted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, times = np.unique(np.concatenate(waiting), return_counts=True)
        return found >> 31, found & 0x7FFFFFFF, times

    for own, rest in halves:
        step = max(1, cells // max(1, len(rest)))
        for start in range(0, len(own), step):
            left, right = own[start:start + step], rest[start:]
            codes = (left[:, None] << 31 | right[None, :])[left[:, None] <= right[None, :]]
            waiting.append(codes)
            size += len(codes)
            if size >= cells:
                yield counted()
                waiting, size = [], 0
    if waiting:
        yield counted()
