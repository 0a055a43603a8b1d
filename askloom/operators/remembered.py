"""Embedding each text once: vectors kept in a store addressed by the text's hash.

A load first compares hashes alone: its distinct ones with those of the store. Only texts
of unseen hashes are then shuffled, once each, and reach the model; their vectors are appended. So a
load of known texts costs a join of 32-byte keys and no call of the model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from askloom.operators.inference import embed
from askloom.plans import scratch, sizing
from askloom.plans.skew import spread_join

STORE = "hash binary, vector array<float>"
UNSEEN_BYTES = 32 << 20  # unseen hashes that go to all tasks; more are joined by a shuffle


def create_store(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], STORE).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch.new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def embed_once(
    texts: DataFrame, store: str, make_predict_fn: Callable[[], Callable], *, text: str = "text", out: str = "vector", batch_size: int = 256
) -> DataFrame:
    """``texts`` with the vectors of a column, as ``inference.embed`` gives them.

    ``texts`` is read several times: pass a stored table. Equal texts, of this load or of
    earlier ones, reach the model once. A null text has a null vector and never reaches
    it; an empty one is a text. One load at a time may write to a store; a model needs one
    of its own.
    """
    spark = texts.sparkSession
    key = F.unhex(F.sha2(F.col(text), 256))
    seen = read_store(spark, store).select("hash")
    asked = texts.select(key.alias("hash")).filter("hash IS NOT NULL").distinct()
    unseen = _stored(asked.join(seen, "hash", "left_anti"), "unseen-hashes")
    few = sizing.broadcast_if_small(unseen, UNSEEN_BYTES)
    fresh = texts.select(key.alias("hash"), F.col(text).alias("text")).join(few, "hash", "left_semi")
    fresh = _stored(fresh.groupBy("hash").agg(F.first("text").alias("text")), "unseen-texts")
    embed(fresh, make_predict_fn, batch_size=batch_size).select("hash", "vector").write.mode("append").parquet(store)
    vectors = read_store(spark, store).select(F.col("hash").alias("__hash"), F.col("vector").alias(out))
    return spread_join(texts.withColumn("__hash", key), vectors, "__hash", "left").drop("__hash")
