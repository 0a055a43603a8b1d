"""Point collections: nested Parquet tables of ``id, vector, norm, payload``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from askloom.functions import vectors
from askloom.plans import scratch


def attach_vectors(
    chunks: DataFrame, embedded: DataFrame, on: tuple[str, ...] = ("doc_id", "chunk_index")
) -> DataFrame:
    """Bring chunks and vectors together by key, never by row order.

    A chunk without a vector stays, with a NULL vector, and so comes among the rejects of
    ``split_by_width`` and ``create_collection``.
    """
    return chunks.join(embedded, list(on), "left")


def as_points(
    df: DataFrame, id: Column, *, source: Column | None = None, chunk_index: Column | None = None
) -> DataFrame:
    """Nested points from ``text, vector`` rows. Payload fields not given are NULL."""
    missing = F.lit(None)
    payload = F.struct(
        F.col("text"),
        (missing if source is None else source).cast("string").alias("source"),
        (missing if chunk_index is None else chunk_index).cast("int").alias("chunk_index"),
    )
    return df.select(
        id.cast("long").alias("id"),
        "vector",
        vectors.norm("vector").alias("norm"),
        payload.alias("payload"),
    )


def split_by_width(points: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Points with vectors of the declared width, and the rejected rest."""
    ok = vectors.has_width("vector", width)
    return points.filter(ok), points.filter(~ok)


def create_collection(
    points: DataFrame, path: str, width: int, *, replace: bool = False, rejects: str | None = None
) -> None:
    """Write a new collection. An existing path is an error unless ``replace`` is set.

    Points of another width go to the ``rejects`` path; without one they fail the write.
    With one, the points are computed once, into the shared folder, and split from there.
    """
    mode = "overwrite" if replace else "errorifexists"
    if rejects is not None:
        staged = scratch.new_path(points.sparkSession, "points")
        points.write.parquet(staged)
        accepted, rejected = split_by_width(points.sparkSession.read.parquet(staged), width)
        rejected.write.mode(mode).parquet(rejects)
    else:
        ok = vectors.has_width("vector", width)
        wrong = F.raise_error(F.lit(f"a vector is not {width} numbers wide"))
        accepted = points.withColumn("vector", F.when(ok, F.col("vector")).otherwise(wrong))
    accepted.write.mode(mode).parquet(path)


def upsert(old: DataFrame, new: DataFrame, version: str | None = None) -> DataFrame:
    """Points of ``new`` replace whole points of ``old`` with the same id.

    If ``new`` repeats ids, the highest ``version`` stays, and of equal versions, or
    without such a column, the point whose JSON text is last; the ranked filter is pruned
    before the shuffle.
    """
    kept = old.join(new.select("id").distinct(), "id", "left_anti")
    others = [c for c in new.columns if c != version]
    ties = F.desc(F.to_json(F.struct(*others)))
    latest = Window.partitionBy("id").orderBy(*([] if version is None else [F.desc(version)]), ties)
    new = new.withColumn("__rank", F.row_number().over(latest)).filter("__rank = 1")
    return kept.unionByName(new.select(others))


def upsert_version(
    spark: SparkSession, old_path: str, new: DataFrame, new_path: str, version: str | None = None
) -> None:
    """Write the merged collection as a new version; a path being read is never replaced."""
    upsert(spark.read.parquet(old_path), new, version).write.mode("errorifexists").parquet(new_path)


def count_points(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("n_points"))
