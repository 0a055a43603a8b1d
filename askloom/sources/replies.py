"""Lines of streamed replies, as a batch table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINE_SCHEMA = "response_id string, seq bigint, line string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Logged lines; their order is ``seq``, never the file order."""
    return spark.read.schema(LINE_SCHEMA).json(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LINE_SCHEMA).json(path)
