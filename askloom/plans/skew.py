"""Joins of a long side, where one key may hold much of it, to one row per key.

Spark's adaptive skew join splits such partitions only if both sides come straight from
a shuffle, which a side made by an aggregation does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SHARE = 1000  # a key is hot if it holds more than one row in SHARE
SALTS = 256


def spread_join(
    long: DataFrame, unique: DataFrame, key: str | list[str], how: str = "inner"
) -> DataFrame:
    """Join ``long`` to ``unique`` on ``key``, with hot keys split into ``SALTS`` parts.

    Several key columns count as one, in which NULL equals NULL; a single one as in SQL.

    Fewer than ``SHARE`` keys can be hot, so their list is a small scalar subquery and
    only their rows of ``unique`` are repeated. ``long`` is read three times, twice for
    its key alone: pass a stored table, or something as cheap to read.
    """
    if not isinstance(key, str):
        joint = F.struct(*key)
        right = unique.withColumn("__key", joint).drop(*key)
        return spread_join(long.withColumn("__key", joint), right, "__key", how).drop("__key")
    hot = _hot_keys(long, key)
    # a row's part must follow from the row, so that a retried task sends it where it went
    # before; rows equal in all columns share a part, and maps have no hash
    hashed = [f.name for f in long.schema if not isinstance(f.dataType, T.MapType)]
    part = F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")
    spread = F.coalesce(F.array_contains(F.col("__hot"), F.col(key)), F.col(key).isNull())
    left = (
        long.withColumn("__hot", hot)
        .withColumn("__salt", F.when(spread, part).otherwise(0))
        .drop("__hot")
    )
    right = (
        unique.withColumn("__hot", hot)
        .withColumn(
            "__salts",
            F.when(
                F.array_contains("__hot", F.col(key)), F.sequence(F.lit(0), F.lit(SALTS - 1))
            ).otherwise(F.array(F.lit(0))),
        )
        .drop("__hot")
        .withColumn("__salt", F.explode("__salts"))
        .drop("__salts")
    )
    return left.join(right, [key, "__salt"], how).drop("__salt")


def _hot_keys(long: DataFrame, key: str) -> Column:
    total = long.agg(F.count("*")).scalar()
    counted = long.groupBy(key).agg(F.count("*").alias("__n"))
    return counted.filter(F.col("__n") * SHARE > total).agg(F.collect_list(key)).scalar()
