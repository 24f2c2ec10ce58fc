"""Dense ids in sorted order without a single-partition window over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketline.session import materialize

_POSITION_BITS = 33


def dense_index(ids: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """Number distinct rows 0..n-1 in sorted order.

    Rows are range-partitioned and sorted once and written to the checkpoint folder, so that the
    partition sizes and the numbering read the same partitions even if an executor is lost. Only
    one row per partition goes through the running total.
    """
    return numbered(materialize(ids.repartitionByRange(*order).sortWithinPartitions(*order)), out)


def numbered(written: DataFrame, out: str = "idx") -> DataFrame:
    """Number the rows of a materialized table 0..n-1 in the order they are written."""
    placed = (written.withColumn("_row", F.monotonically_increasing_id())
              .withColumn("_part", F.shiftright("_row", _POSITION_BITS)))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset")))
    position = F.col("_row").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (placed.join(F.broadcast(offsets), "_part")
            .select(*written.columns, (position + F.col("_offset")).alias(out)))
