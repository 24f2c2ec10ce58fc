"""What the operators' modules share: reading, fixed tests on ids, written tables and partition counts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id as bigint, text (null: empty) and the named columns; rows without a doc_id take no part."""
    return (df.where(F.col("doc_id").isNotNull())
            .select(F.col("doc_id").cast("bigint").alias("doc_id"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more))


def id_fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read again: later steps start from the files, whichever executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int = 2 << 20) -> Iterator[None]:
    """Rows go to Python workers in batches of about `size` bytes, where Spark's own bound is 64 MB; for jobs that run meanwhile."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Written tables of one flow, each deleted once the tables made from it are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = scratch_path(self.spark, name)
        df.write.parquet(self.paths[name])
        return self.spark.read.parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        """Delete tables, and let Spark's cleaner drop the shuffle files of plans that are no longer held."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.spark._jvm.System.gc()


def with_text(rows: DataFrame, row: str, text: Column, columns: list[str]) -> DataFrame:
    """The struct column `row` as columns again, with another text and, if it is there, n_chars."""
    changed = {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(row)[c].alias(c) for c in columns])
