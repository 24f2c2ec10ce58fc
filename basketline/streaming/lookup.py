"""The batch lookup over a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from basketline.operators.lookup import resolve


def answer_stream(requests: DataFrame, recommendations: DataFrame, fallbacks: DataFrame, out: str,
                  checkpoint: str) -> StreamingQuery:
    """Resolve a streaming request table against the static list tables, appending responses as parquet.

    Stateless: each micro-batch is one stream-static join, so there is no watermark or late data.
    """
    return (resolve(requests, recommendations, fallbacks).writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint).start())


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests dropped as JSON files into a folder."""
    return spark.readStream.schema("request_id bigint, customer_id string, mode string").json(path)
