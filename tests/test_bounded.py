"""Exact search by bounds equals the search that scores every pair."""

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from askloom.operators import clusters, search

WIDTH = 16


def table(spark, vectors, first=0, more=""):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(vectors)], "id long, vector array<float>")


def layout(spark, points, middles, tmp_path):
    clusters.write_clustered(points, middles, str(tmp_path / "points"), width=WIDTH)
    held = spark.read.parquet(str(tmp_path / "points"))
    clusters.radii(held, middles, width=WIDTH).write.parquet(str(tmp_path / "radii"))
    return held, spark.read.parquet(str(tmp_path / "radii"))


def test_bounds_leave_out_most_points_of_tight_clusters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clusters, "CELL_POINTS", 64)
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((30, WIDTH))
    near = centers[rng.integers(0, 30, 1500)] + 0.05 * rng.standard_normal((1500, WIDTH))
    near[:500] = near[0]  # a third of the points are equal
    odd = [[1.0] * (WIDTH - 1), [0.0] * WIDTH, [float("nan")] * WIDTH, None, []]
    points = table(spark, near.tolist() + odd)
    middles = table(spark, centers.tolist())
    held, sizes = layout(spark, points, middles, tmp_path)
    asked = table(spark, (centers[rng.integers(0, 30, 60)] + 0.1 * rng.standard_normal((60, WIDTH))).tolist() + odd).withColumnRenamed("id", "query_id")
    got = clusters.bounded_top_k(asked, held, middles, sizes, width=WIDTH)
    assert rows(got) == rows(search.top_k(asked, points, width=WIDTH))
    share = clusters.scored_share(asked, held, middles, sizes, width=WIDTH).first()
    assert share["pairs"] == 65 * 1500 and share["scored"] < 0.35 * share["pairs"]
    limits = asked.withColumn("limit", F.when(F.col("query_id") % 3 > 0, F.col("query_id") % 5).cast("int"))
    got = clusters.bounded_top_k(limits, held, middles, sizes, width=WIDTH, min_score=-1.0)
    assert rows(got) == rows(search.top_k(limits, points, width=WIDTH, min_score=-1.0))


def test_loose_clusters_and_no_queries(spark, tmp_path):
    rng = np.random.default_rng(2)
    points = table(spark, rng.standard_normal((300, WIDTH)).tolist())
    middles = table(spark, rng.standard_normal((5, WIDTH)).tolist())
    held, sizes = layout(spark, points, middles, tmp_path)
    asked = table(spark, rng.standard_normal((40, WIDTH)).tolist()).withColumnRenamed("id", "query_id")
    got = clusters.bounded_top_k(asked, held, middles, sizes, width=WIDTH, limit=7, min_score=0.0)
    assert rows(got) == rows(search.top_k(asked, points, width=WIDTH, limit=7, min_score=0.0))
    assert clusters.bounded_top_k(asked.limit(0), held, middles, sizes, width=WIDTH).collect() == []
    probed = clusters.probe_top_k(asked, held, middles, width=WIDTH, probes=5, limit=7, min_score=0.0)
    assert rows(probed) == rows(got)


def test_all_clusters_are_scored_by_one_job(spark, tmp_path):
    points = table(spark, np.eye(WIDTH).tolist())
    held, sizes = layout(spark, points, points, tmp_path)
    asked = points.withColumnRenamed("id", "query_id")
    plan = clusters.probe_top_k(asked, held, points, width=WIDTH, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan
