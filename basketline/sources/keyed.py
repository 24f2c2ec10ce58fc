"""A table of keyed rows in hash buckets, of which an update writes only the buckets it touches.

A version is a small index from bucket to folder; folders of untouched buckets are shared with the
version before. The index is switched last, so a stopped update changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.sources import versions

BUCKETS = 64


class KeyedTable:
    """Rows under `root`, one per key."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.schema, self.buckets = spark, root, list(keys), schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def index(self) -> dict[int, str]:
        """Folder of each bucket that holds rows."""
        folder = versions.current(self.spark, self.root)
        return {} if folder is None else {int(b): p for b, p in json.loads(self.spark.read.text(f"{folder}/index").first()[0]).items()}

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        folders = sorted(p for b, p in self.index().items() if only is None or b in only)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def upsert(self, rows: DataFrame) -> list[int]:
        """Insert rows or replace those of the same key; returns the buckets that were written. A key comes once."""
        names = self.spark.createDataFrame([], self.schema).columns
        new = rows.select(*names).withColumn("_bucket", self._bucket())
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most `buckets` numbers
        repeated = new.groupBy(*self.keys).count().filter("count > 1").limit(1).count()
        if repeated:
            raise ValueError(f"rows to upsert repeat a key of {', '.join(self.keys)}")
        if not touched:
            return []
        same_key = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        old = self.read(touched).withColumn("_bucket", self._bucket())
        kept = old.alias("o").join(new.select(*self.keys).alias("n"), same_key, "left_anti")
        folder = versions.new_version(self.root)
        both = kept.unionByName(new)
        both.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{folder}/rows")
        index = self.index() | {b: f"{folder}/rows/_bucket={b}" for b in touched}
        text = json.dumps({str(b): p for b, p in sorted(index.items())})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/index")
        versions.switch(self.spark, self.root, folder)
        return touched
