"""Packing documents into sequences: shortest pack first over the histogram of lengths.

Every document's ids are cut at multiples of the sequence length, so that only the last piece of a
document is short. The histogram of piece lengths has at most `size` entries. Lengths are placed
longest first, each into the pack with the most room left; packs that hold the same lengths are one
pattern with a count, so the work depends on the number of lengths and not of documents. Patterns
then give, for each length, runs of ranks with their sequence and offset, and a piece finds its
place by its rank among the pieces of its length.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are packed
each; rows without a doc_id take no part; no rows give no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketline.llm.common import documents, written
from basketline.llm.text import slices
from basketline.llm.tokens import PieceIds, with_end


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceIds(tokenizer_path)  # what it remembers goes with the task
        for batch in batches:
            for rows, texts in slices(batch):
                bounds, ids = with_end(*encoder.encode(texts), end_id)
                ids, out = ids.astype("<u4"), []
                for k, d in enumerate(rows.column("doc_id").to_pylist()):
                    begin, end = bounds[k], bounds[k + 1]
                    out += [(d, a - begin, min(size, end - a), zlib.crc32(ids[a:min(a + size, end)].tobytes()), end - begin)
                            for a in range(begin, end, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents(docs).mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many packs, the lengths in each) of every pattern."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in by_room if r >= length), default=size)
            waiting = by_room.get(room)
            if waiting:
                packs, pattern = waiting.pop()
                if not waiting:
                    del by_room[room]
            else:
                packs, pattern = left, ()
            # as many of this length in one pack as there is room, unless too few are left
            each = max(1, min(room // length, left // packs)) if pattern else 1
            used = min(packs, left // each)
            if used < packs:
                by_room.setdefault(room, []).append((packs - used, pattern))
            by_room.setdefault(room - each * length, []).append((used, pattern + (length,) * each))
            left -= used * each
    return [p for room in sorted(by_room) for p in by_room[room]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Runs of ranks by (length, first rank), with the sequence of the first rank and the offset in the sequence."""
    rows, used, sequence = [], {}, 0
    for packs, pattern in patterns:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length] = first + packs
            offset += length
        sequence += packs
    rows.sort()
    return {name: np.array([r[k] for r in rows], np.int64) for k, name in enumerate(("length", "first", "sequence", "offset"))}


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    cut = written(cut_pieces(docs, tokenizer_path, end_id, size), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `size` rows at most
    runs = places(shortest_pack_first(histogram, size))
    key = runs["length"] << 44 | runs["first"]

    parts = math.isqrt(max(histogram.values(), default=1)) + 1  # as many parts of a length as rows in a part, at most
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts))
    cut = cut.withColumn("part", part)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
              .select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    ranked = (cut.withColumn("row", F.row_number().over(within)).join(before, ["length", "part"])
              .withColumn("rank", F.col("before") + F.col("row") - 1).drop("row", "before", "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            placed = {"sequence_id": runs["sequence"][at] + rank - runs["first"][at], "offset": runs["offset"][at]}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | placed)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*columns, "sequence_id", "offset"]))
