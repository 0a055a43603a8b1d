"""Size checks that decide between a broadcast and a shuffled plan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 32 << 20  # query vectors and hits that go to every task
CELL_BYTES = 128 << 20  # query vectors and hits held by one task of a grid

NUMBER_BYTES, HIT_BYTES, ROW_BYTES = 8, 24, 64


def query_rows(width: int, limit: int, max_bytes: int) -> int:
    """How many queries fit: each holds ``width`` numbers and up to ``limit`` hits."""
    return max(1, max_bytes // (width * NUMBER_BYTES + limit * HIT_BYTES))


def small_table(df: DataFrame, max_rows: int, max_bytes: int) -> pa.Table | None:
    """The rows of ``df`` if there are at most ``max_rows`` with ids and vectors within
    ``max_bytes``, else None.

    ``df`` has ``query_id`` and ``vector``. Measuring first needs no shuffle of its rows;
    a ``limit`` would send up to ``max_rows`` rows of every partition to one task.
    """
    numbers = F.coalesce(F.size("vector"), F.lit(0)) * NUMBER_BYTES
    names = F.octet_length(F.to_json(F.struct("query_id")))
    size = F.coalesce(F.sum((numbers + names).cast("long")), F.lit(0))
    rows, held = df.agg(F.count("*"), size).first()
    return None if rows > max_rows or held > max_bytes else df.toArrow()


def text_bytes(df: DataFrame) -> int:
    """Bytes of all rows as JSON text, with the row overhead of a broadcast table."""
    size = F.octet_length(F.to_json(F.struct(*df.columns))) + ROW_BYTES
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, max_bytes: int) -> DataFrame:
    """Mark ``df`` for a broadcast join if its rows have at most ``max_bytes``.

    A larger table is left to Spark, which shuffles and splits skewed partitions.
    """
    return df if text_bytes(df) > max_bytes else F.broadcast(df)
