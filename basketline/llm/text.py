"""Vectorised access to whole texts inside tasks: slices, pieces, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts worked on at once; a longer text is a slice of its own

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
POINT = np.zeros(256, bool)
POINT[[ord(c) for c in ",.;:!?"]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def clean_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts of a column as one array; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of an array of texts."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut a batch into runs of rows of at most `limit` text bytes (one row at least), with their texts."""
    texts = clean_texts(batch.column(text))
    offsets, _ = raw(texts)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row), texts.slice(row, end - row)
        row = end


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """slices() of a column of texts alone."""
    return (texts for _, texts in slices(pa.RecordBatch.from_arrays([column], names=["text"]), limit=limit))


def pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Cut each text before every run of ASCII white space and between an ASCII letter and a point or comma.

    Returns the first piece of each text (one more entry than texts) and all pieces, which are the
    text when joined.
    """
    offsets, data = raw(texts)
    space = SPACE[data]
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[1:] |= POINT[data[1:]] & LETTER[data[:-1]]
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.flatnonzero(starts)
    bounds = np.append(at, len(data)).astype(np.int32)
    cut = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return np.searchsorted(at, offsets), cut


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, starts, ends) of the runs of bytes that are not ASCII white space."""
    inside = ~SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[:-1] = True
    begins[1:-1] = ~inside[:-1]
    begins[offsets] = True
    starts = np.flatnonzero(inside & begins[:-1])
    stops = np.zeros(len(data) + 1, bool)
    stops[:-1] = ~inside
    stops[offsets] = True
    ends = np.flatnonzero(inside & stops[1:]) + 1
    return np.searchsorted(starts, offsets), starts, ends


def word_counts(texts: pa.Array) -> np.ndarray:
    offsets, data = raw(texts)
    return np.diff(word_bounds(offsets, data)[0])


_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        tables = []
        for base in (_M, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if size <= 1 << 23:
            _powers.clear()
            _powers[size] = tuple(tables)
        return tuple(tables)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each text, 64-bit hash of every word), letters A-Z lower-cased."""
    return words_with_tails(texts)[:2]


def words_with_tails(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes() and, as one number, the last two bytes of every word."""
    offsets, data = raw(texts)
    first, starts, ends = word_bounds(offsets, data)
    if not len(starts):
        return first, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    last = LOWER[data[ends - 1]].astype(np.int64)
    tails = last + 256 * np.where(ends - starts > 1, LOWER[data[np.maximum(ends - 2, 0)]], 0).astype(np.int64)
    return first, mix(value ^ mix((ends - starts).astype(np.uint64))), tails
