"""A bit table of fixed size that tells rows which a later join can't match from the rest.

It never leaves out a row that matches: more keys than it is made for only let more other
rows pass, which the join then drops. So it may go to every task at any size of the data.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

BITS = 1 << 24  # two megabytes


def bit_table(spark: SparkSession, keys: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """The bits of a long column's low digits, combined by Spark and sent to all tasks."""
    bit = F.pmod(F.col(column), F.lit(bits))
    words = keys.select(F.floor(bit / 64).alias("word"), (bit % 64).cast("int").alias("at"))
    words = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("set"))
    table = np.zeros(bits // 64, np.int64)
    found = words.toArrow()  # at most bits / 64 rows
    table[found["word"].to_numpy()] = found["set"].to_numpy()
    return spark.sparkContext.broadcast(table)


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys % np.int64(len(table) * 64)
    return (table[bit // 64] >> (bit % 64)) & 1 == 1
