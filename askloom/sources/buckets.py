"""Collections cut into buckets of ids, of which an upsert writes only those it touches.

A version is a list of folders, one per bucket. An upsert reads and rewrites the buckets
that hold new ids and lists the folders of all others again, so readers of an older version
are not disturbed and a small upsert costs a small part of the collection. Two writers
of the same version can't both succeed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askloom.sources import collections

BUCKETS = 64


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(buckets)).cast("int")


def _write_data(points: DataFrame, path: str, buckets: int) -> str:
    """Write points by bucket; ids are spread over tasks within a bucket."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    placed = points.withColumn("bucket", bucket_of(buckets))
    placed.repartitionByRange("bucket", "id").write.partitionBy("bucket").parquet(folder)
    return folder


def _write_version(spark: SparkSession, path: str, version: int, buckets: int, folders: dict[int, str]) -> None:
    rows = [(buckets, b, f) for b, f in sorted(folders.items())]
    listed = spark.createDataFrame(rows, "buckets int, bucket int, folder string").coalesce(1)
    listed.write.mode("errorifexists").parquet(f"{path}/versions/version={version}")


def latest_version(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]


def folders_of(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, str]]:
    """The number of buckets and the folder of each that has points; a row per bucket."""
    version = latest_version(spark, path) if version is None else version
    rows = spark.read.parquet(f"{path}/versions/version={version}").collect()
    return rows[0]["buckets"], {r["bucket"]: r["folder"] for r in rows if r["folder"] is not None}


def create_buckets(points: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the first version of a collection; an existing one is an error."""
    spark = points.sparkSession
    folder = _write_data(points, path, buckets)
    used = _used(spark, folder, range(buckets))
    folders = {b: f"{folder}/bucket={b}" if b in used else None for b in range(buckets)}
    _write_version(spark, path, 1, buckets, folders)


def _used(spark: SparkSession, folder: str, buckets) -> set[int]:
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return {b for b in buckets if fs.exists(place(f"{folder}/bucket={b}"))}


def read_buckets(spark: SparkSession, path: str, version: int | None = None, only: set[int] | None = None) -> DataFrame:
    """The points of a version, the latest if none is named; ``only`` of some buckets."""
    _, folders = folders_of(spark, path, version)
    chosen = [f for b, f in sorted(folders.items()) if only is None or b in only]
    if not chosen:
        some = next(iter(folders.values()))
        return spark.read.parquet(some).limit(0)
    return spark.read.parquet(*chosen)


def upsert_buckets(spark: SparkSession, path: str, new: DataFrame, version: str | None = None) -> int:
    """Write the next version, in which ``new`` replaces points of the same id; its number.

    ``version`` is the column that orders repeated ids in ``new``, as in
    ``collections.upsert``. Only buckets of new ids are read and written.
    """
    last = latest_version(spark, path)
    buckets, folders = folders_of(spark, path, last)
    touched = {r[0] for r in new.select(bucket_of(buckets)).distinct().collect()}  # at most ``buckets``
    if touched:
        old = read_buckets(spark, path, last, touched)
        merged = collections.upsert(old, new.select(*old.columns, *([version] if version else [])), version)
        folder = _write_data(merged, path, buckets)
        folders = folders | {b: f"{folder}/bucket={b}" for b in touched}
    _write_version(spark, path, last + 1, buckets, {b: folders.get(b) for b in range(buckets)})
    return last + 1
