"""Connected components of a distributed list of links, by alternating stars.

Each round links every larger neighbour of a node to its smallest neighbour (large star) and then
every smaller neighbour (small star); components become stars around their smallest node after a
number of rounds that grows with the logarithm of their size. Links stay in tables; a node with
very many links is one side of a join on its smallest neighbour, which Spark splits if it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import written


def _linked_to_least(both: DataFrame, wanted: str) -> DataFrame:
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where(wanted).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that it is linked with, over any number of links) of all nodes in links (a, b)."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both, "v > u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _linked_to_least(large, "true")
        edges = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
