"""Positions within groups of any length.

A window over a whole group sorts that group in one task. Here a group is cut into
buckets of its integer order column, and if need be the buckets into larger ones. Each
window sees one bucket; totals of what lies before it come from the level above, so a
session holding a third of all rows is spread like any other. One level is enough for
10^11 rows in a group: two million bucket totals remain for the window over the group.
The width of a bucket follows the density of the order column, so a sparse order, such as
a time, makes buckets of as many rows as a dense one. Keys may be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_ROWS = 65536


def bucket_sizes(df: DataFrame, order: str, rows: int = BUCKET_ROWS) -> tuple[int, ...]:
    """Width of a bucket that holds ``rows`` rows on average, from one pass over ``order``."""
    found = df.agg(F.count(order).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    return (max(1, (found["hi"] - found["lo"] + 1) * rows // found["n"]),) if found["n"] else (rows,)


def bucket_of(order: str, size: int) -> Column:
    """The multiple of ``size`` at or below an integer column."""
    return F.col(order) - F.pmod(F.col(order), F.lit(size))


def running_sums(
    df: DataFrame, keys: list[str], order: str, names: list[str], sizes: tuple[int, ...]
) -> DataFrame:
    """Add ``<name>_before`` and ``<name>_total`` for each summed column.

    The first is the sum over the rows of the group that come earlier, the second the sum
    over the whole group. ``order`` must be unique and not NULL within ``keys``; ``sizes``
    are the bucket sizes, each a multiple of the one before.
    """

    def before(name: str, within: list[str]) -> Column:
        earlier = Window.partitionBy(*within).orderBy(order)
        summed = F.sum(name).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(summed, F.lit(0))

    if not sizes:
        group = Window.partitionBy(*keys)
        added = {f"{n}_before": before(n, keys) for n in names}
        return df.withColumns(added | {f"{n}_total": F.sum(n).over(group) for n in names})

    bucket = f"__bucket{len(sizes)}"
    cut = df.withColumn(bucket, bucket_of(order, sizes[0]))
    totals = cut.groupBy(*keys, bucket).agg(*(F.sum(n).alias(n) for n in names))
    offsets = running_sums(totals, keys, bucket, names, sizes[1:]).select(
        *keys,
        bucket,
        *(F.col(f"{n}_before").alias(f"__{n}_offset") for n in names),
        *(f"{n}_total" for n in names),
    )
    held = offsets.withColumnsRenamed({k: f"__held_{k}" for k in [*keys, bucket]})
    same = [F.col(k).eqNullSafe(F.col(f"__held_{k}")) for k in [*keys, bucket]]
    placed = cut.join(held, same).drop(*(f"__held_{k}" for k in [*keys, bucket]))
    inside = {
        f"{n}_before": F.col(f"__{n}_offset") + before(n, [*keys, bucket]) for n in names
    }
    return placed.withColumns(inside).drop(bucket, *(f"__{n}_offset" for n in names))


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: str,
    starts: Column,
    sizes: tuple[int, ...] | None = None,
) -> DataFrame:
    """Add positions to rows ordered by ``order``, an integer unique within ``keys``.

    ``row_no`` counts rows and ``start_no`` counts rows where ``starts`` holds, both up
    to and including the row; ``n_starts`` is the total of the latter in the group.
    Without ``sizes`` the order column is read once more to choose them.
    """
    marked = df.withColumn("__row", F.lit(1).cast("long")).withColumn(
        "__start", F.coalesce(starts, F.lit(False)).cast("long")
    )
    sizes = bucket_sizes(df, order) if sizes is None else sizes
    summed = running_sums(marked, keys, order, ["__row", "__start"], sizes)
    return (
        summed.withColumn("row_no", F.col("__row_before") + 1)
        .withColumn("start_no", F.col("__start_before") + F.col("__start"))
        .withColumnRenamed("__start_total", "n_starts")
        .drop("__row", "__start", "__row_before", "__start_before", "__row_total")
    )
