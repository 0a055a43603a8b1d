"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_PATH = "_stored_path"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where one process is all there is, a folder made here."""
    named = spark.conf.get(_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {_KEY} to a folder that all executors can reach")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="checkpoints-"))
    return _own[0]


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again, which cuts its lineage.

    What was shuffled for it is deleted once it is written; else it stays on the executors'
    disks until the driver happens to collect its garbage.
    """
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    held = spark.read.schema(df.schema).parquet(path)
    held.__dict__[_PATH] = path
    return held


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` gave, once all that reads them is stored.

    Tables that were not stored here are left alone.
    """
    for df in tables:
        path = df.__dict__.pop(_PATH, None)
        if path is not None:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
