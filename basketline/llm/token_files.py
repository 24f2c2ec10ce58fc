"""Token ids in length-delimited binary records, with a separate offset index.

A file is a sequence of records, one for a document, documents ascending by id over the files in
the order of their part numbers. A record is

    u64  length of the payload
    u32  masked checksum of those 8 bytes
    ...  payload: i64 doc_id, u8 bytes per id (2 or 4), the ids; all little-endian
    u32  masked checksum of the payload
    u8   line feed

A masked checksum is the CRC-32 rotated right by 15 bits plus a constant, so that checksums of data
that holds checksums stay sound. Spark's own writer makes and commits the files, on whatever store
the path names: a lost executor's part is written again and never seen half. The index (file, part,
offset, length, doc_id, ids before the record in its file, ids) is a Parquet folder beside them.

Defined results: a null or empty text is a record with the end id alone; equal ids stay in the
order of their texts' hashes; rows without a doc_id take no part; no rows give no records.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketline.llm.common import documents
from basketline.llm.text import slices
from basketline.llm.tokens import PieceIds, load, with_end

HEAD = struct.Struct("<QI")
BODY = struct.Struct("<qB")
MASK_ROTATE, MASK_ADD = 15, 0xA282EAD8

def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> MASK_ROTATE) | (crc << (32 - MASK_ROTATE))) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray, id_bytes: int) -> bytes:
    """One record without its line feed, which the writer adds."""
    payload = BODY.pack(doc_id, id_bytes) + ids.astype(f"<u{id_bytes}").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def record_at(data: bytes | memoryview, offset: int) -> tuple[int, np.ndarray, int]:
    """(doc_id, ids, offset of the next record); damage raises."""
    size, check = HEAD.unpack_from(data, offset)
    if masked(bytes(data[offset:offset + 8])) != check:
        raise ValueError(f"damaged length at byte {offset}")
    begin = offset + HEAD.size
    payload = data[begin:begin + size]
    if len(payload) != size or masked(payload) != struct.unpack_from("<I", data, begin + size)[0]:
        raise ValueError(f"damaged record at byte {offset}")
    doc_id, id_bytes = BODY.unpack_from(payload)
    return doc_id, np.frombuffer(payload, f"<u{id_bytes}", offset=BODY.size), begin + size + 5


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """Encode every text, sort by doc_id over the whole table and write `folder`/records and `folder`/index."""
    id_bytes = 2 if load(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceIds(tokenizer_path)  # what it remembers goes with the task
        for batch in batches:
            for rows, texts in slices(batch):
                bounds, ids = with_end(*encoder.encode(texts), end_id)
                values = [frame(d, ids[bounds[k]:bounds[k + 1]], id_bytes) for k, d in enumerate(rows.column("doc_id").to_pylist())]
                yield pa.RecordBatch.from_pydict({"record": pa.array(values, pa.binary())})

    (documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
     .mapInArrow(run, "record binary").select(F.col("record").cast("string"))
     .write.option("compression", "none").text(f"{folder}/records"))
    read_records(docs.sparkSession, folder).drop("ids_crc32").write.parquet(f"{folder}/index")


def record_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, part, content of every data file; a file holds one partition and so is bounded by it."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records")
            .select(F.col("path").alias("file"), F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint").alias("part"), "content"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row for a record, checked: file, part, offset, length, doc_id, before, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, part, content in zip(*(batch.column(c) for c in ("file", "part", "content"))):
                data, rows, offset, before = memoryview(content.as_buffer()), [], 0, 0
                while offset < len(data):
                    doc_id, ids, after = record_at(data, offset)
                    rows.append((offset, after - offset, doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    offset, before = after, before + len(ids)
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()] * len(rows), pa.string()), pa.array([part.as_py()] * len(rows), pa.int64()),
                     *(pa.array(c, pa.int64()) for c in columns)],
                    names=["file", "part", "offset", "length", "doc_id", "before", "n_tokens", "ids_crc32"])

    return record_files(spark, folder).mapInArrow(
        run, "file string, part bigint, offset bigint, length bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")


def token_positions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 read back from the files; start counts the ids of all records before."""
    records = read_records(spark, folder)
    totals = spark.read.parquet(f"{folder}/index").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for a file
    base = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return (records.join(base, "part")
            .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def shuffled_records(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """doc_id, ids in an order drawn from the seed: the index is shuffled, records are cut out at their offsets."""
    index = spark.read.parquet(f"{folder}/index").select("file", "offset", "doc_id")
    wanted = index.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets in zip(batch.column("content"), batch.column("offsets").to_pylist()):
                data = memoryview(content.as_buffer())
                found = [record_at(data, o)[:2] for o in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()),
                                                  pa.array([i.astype(np.int64) for _, i in found], pa.list_(pa.int64()))],
                                                 names=["doc_id", "ids"])

    rows = record_files(spark, folder).join(wanted, "file").select("content", "offsets")
    return rows.mapInArrow(run, "doc_id bigint, ids array<bigint>").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
