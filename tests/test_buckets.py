"""Upserts into buckets: the points, the folders kept, older versions."""

import pytest
from conftest import rows
from pyspark.errors import AnalysisException

from askloom.sources import buckets, collections


def points(spark, ids, mark):
    return spark.createDataFrame([(i, [float(i), mark]) for i in ids], "id long, vector array<double>")


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "c")
    buckets.create_buckets(points(spark, range(300), 0.0), path, 16)
    _, before = buckets.folders_of(spark, path)
    new = points(spark, [3, 5, 1000], 1.0)
    assert buckets.upsert_buckets(spark, path, new) == 2
    _, after = buckets.folders_of(spark, path)
    touched = {r[0] for r in new.select(buckets.bucket_of(16)).collect()}
    assert {b for b in before if after[b] != before[b]} == touched and 0 < len(touched) <= 3
    want = collections.upsert(points(spark, range(300), 0.0), new)
    assert rows(buckets.read_buckets(spark, path)) == rows(want)
    assert rows(buckets.read_buckets(spark, path, 1)) == rows(points(spark, range(300), 0.0))
    files = [f.split("/data/")[1] for f in buckets.read_buckets(spark, path).inputFiles()]
    assert {f.split("bucket=")[1].split("/")[0] for f in files} == {str(b) for b in after}


def test_repeated_ids_empty_upserts_and_two_writers(spark, tmp_path):
    path = str(tmp_path / "c")
    buckets.create_buckets(points(spark, [1, 2], 0.0), path, 8)
    twice = spark.createDataFrame([(2, [1.0], 1), (2, [2.0], 2), (9, [3.0], 1)], "id long, vector array<double>, v int")
    assert buckets.upsert_buckets(spark, path, twice, version="v") == 2
    assert rows(buckets.read_buckets(spark, path)) == [(1, [1.0, 0.0]), (2, [2.0]), (9, [3.0])]
    assert buckets.upsert_buckets(spark, path, points(spark, [], 0.0)) == 3
    assert buckets.read_buckets(spark, path).count() == 3
    with pytest.raises(AnalysisException):
        buckets._write_version(spark, path, 3, 8, {})
