"""Where intermediate and streamed tables are written."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOCAL_ROOT = "/tmp/askloom-checkpoints"  # where one process is all there is


def shared_root(spark: SparkSession) -> str:
    """The shared folder the session names. Who names it also deletes what is in it."""
    named = spark.conf.get(_KEY, None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {_KEY} to a folder that all executors can reach")
    return LOCAL_ROOT


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What jobs begun in here shuffle is deleted when they end; else it stays on the executors'
    disks until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def written(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """``df`` written below ``path`` and read again, without the shuffles it took."""
    with shuffles_deleted(df.sparkSession):
        df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
