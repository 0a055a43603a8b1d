import math
import tracemalloc

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from askloom.operators import block_scores, clusters, search
from askloom.functions import vectors
from askloom.plans import sizing

WIDTH = 8
POINTS = "id long, vector array<float>"
QUERIES = "query_id string, vector array<float>, limit int"


def brute_force(queries, points, min_score=0.3, limit=3):
    """All scores in plain Python, independent of the library."""
    found = []
    for key, q, own in queries:
        k = limit if own is None else own
        scored = []
        for pid, p in points:
            if p is None or q is None or len(p) != WIDTH or len(q) != WIDTH:
                continue
            if any(x is None or math.isnan(x) for x in [*p, *q]):
                continue
            p32, q32 = [np.float32(x).item() for x in p], [np.float32(x).item() for x in q]
            size = math.sqrt(math.fsum(x * x for x in p32)) * math.sqrt(math.fsum(x * x for x in q32))
            if size == 0:
                continue
            score = math.fsum(x * y for x, y in zip(p32, q32)) / size
            if score >= min_score:
                scored.append((-round(score, 9), pid))
        for rank, (score, pid) in enumerate(sorted(scored)[: max(k, 0)], 1):
            found.append((key, rank, pid, round(-score, 6)))
    return sorted(found)


def random_data(seed=7, n=400, copies=150):
    rng = np.random.default_rng(seed)
    points = [(i, rng.normal(size=WIDTH).tolist()) for i in range(n)]
    hot = rng.normal(size=WIDTH).tolist()
    points += [(n + i, hot) for i in range(copies)]  # one vector held by many ids
    points += [(9001, [0.0] * WIDTH), (9002, [1.0] * 3), (9003, None)]
    points += [(9004, [None] + [1.0] * (WIDTH - 1)), (9005, [float("nan")] * WIDTH)]
    queries = [(f"q{i}", rng.normal(size=WIDTH).tolist(), [None, 0, 1, 5, 40][i % 5]) for i in range(60)]
    queries += [("copy", hot, 4), ("scaled", [1000 * x for x in hot], None)]
    queries += [("zero", [0.0] * WIDTH, None), ("short", [1.0], None), ("none", None, None)]
    return queries, points


@pytest.mark.parametrize("strategy", ["broadcast", "grid", "auto"])
def test_equals_brute_force(spark, strategy):
    queries, points = random_data()
    hits = search.top_k(
        spark.createDataFrame(queries, QUERIES),
        spark.createDataFrame(points, POINTS).repartition(5),
        width=WIDTH,
        strategy=strategy,
    )
    got = rows(hits.withColumn("score", F.round("score", 6)))
    assert got == brute_force(queries, points)


def test_small_tiles_and_query_blocks_change_nothing(spark, monkeypatch):
    queries, points = random_data(seed=11)
    monkeypatch.setattr(sizing, "query_rows", lambda *a: 16)
    hits = search.top_k(
        spark.createDataFrame(queries, QUERIES), spark.createDataFrame(points, POINTS), width=WIDTH
    )
    assert "MapInArrow" in plan_of(hits) and "REPARTITION_BY_NUM" in plan_of(hits)
    assert rows(hits.withColumn("score", F.round("score", 6))) == brute_force(queries, points)


def test_broadcast_beyond_the_bound_is_refused(spark, monkeypatch):
    queries, points = random_data()
    monkeypatch.setattr(sizing, "query_rows", lambda *a: 16)
    with pytest.raises(ValueError):
        search.top_k(
            spark.createDataFrame(queries, QUERIES),
            spark.createDataFrame(points, POINTS),
            width=WIDTH,
            strategy="broadcast",
        )


def test_kernel_in_tiny_tiles(monkeypatch):
    monkeypatch.setattr(block_scores, "TILE_SCORES", 64)
    monkeypatch.setattr(block_scores, "SLAB_PAIRS", 10)
    rng = np.random.default_rng(3)
    q, p = rng.normal(size=(23, WIDTH)), rng.normal(size=(500, WIDTH))
    p[100:300] = p[100]
    ids = rng.permutation(500)
    top = block_scores.TopHits(q, np.full(23, 3), 0.1)
    for low in range(0, 500, 37):
        top.add(ids[low : low + 37], p[low : low + 37])
    got = sorted(zip(top.q.tolist(), (-top.scores).round(9).tolist(), top.ids.tolist()))
    scores = (q @ p.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(p, axis=1)
    want = []
    for i in range(23):
        best = sorted((-round(s, 9), int(d)) for s, d in zip(scores[i], ids) if s >= 0.1)[:3]
        want += [(i, s, d) for s, d in best]
    assert got == sorted(want)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cross_join_and_cut_groups_early(spark):
    queries, points = random_data(n=20, copies=2)
    q, p = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(points, POINTS)
    for strategy, shuffles in [("broadcast", 1), ("grid", 2)]:
        plan = plan_of(search.top_k(q, p, width=WIDTH, strategy=strategy))
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert plan.count("WindowGroupLimit") == 2
        assert plan.count("Exchange ") == shuffles


def test_no_queries_and_no_points(spark):
    queries, points = random_data(n=5, copies=1)
    q, p = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(points, POINTS)
    for strategy in ["broadcast", "grid"]:
        assert search.top_k(q.filter("false"), p, width=WIDTH, strategy=strategy).count() == 0
        assert search.top_k(q, p.filter("false"), width=WIDTH, strategy=strategy).count() == 0


def test_nearest_orders_ties_by_id_and_drops_null_scores(spark):
    points = [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, [0.0, 1.0]), (5, [2.0, 0.1])]
    df = spark.createDataFrame(points, POINTS)
    hits = search.nearest(df, F.array(F.lit(1.0), F.lit(0.0)), limit=4)
    assert [r["id"] for r in hits.collect()] == [1, 3, 5]
    assert "TakeOrderedAndProject" in plan_of(hits)


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], POINTS)
    q = spark.createDataFrame([("a", [1.0, 0.0], None)], QUERIES)
    assert search.top_k(q, df, width=2, min_score=1.0).count() == 1
    assert search.nearest(df, F.array(F.lit(1.0), F.lit(0.0)), min_score=1.0).count() == 1


def test_vector_expressions(spark):
    df = spark.createDataFrame(
        [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])],
        "a array<float>, b array<float>",
    )
    got = df.select(vectors.dot("a", "b"), vectors.norm("a"), vectors.cosine("a", "b")).collect()
    assert [tuple(r) for r in got] == [(24.0, 5.0, 0.96), (0.0, 0.0, None), (None, 1.0, None)]
    known = df.select(vectors.cosine("a", "b", F.lit(5.0), F.lit(5.0))).first()[0]
    assert known == 0.96


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Twelve well separated directions; one holds a third of all points."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, WIDTH))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    owner = np.where(np.arange(1200) % 3 == 0, 0, rng.integers(1, 12, 1200))
    data = middles[owner] + rng.normal(scale=0.05, size=(1200, WIDTH))
    rows_ = [(i, v.tolist()) for i, v in enumerate(data)] + [(5000, [0.0] * WIDTH), (5001, [1.0])]
    points = spark.createDataFrame(rows_, POINTS)
    path = str(tmp_path_factory.mktemp("index") / "v1")
    model = clusters.fit_clusters(points, 12, width=WIDTH, seed=3)
    clusters.write_clustered(points, clusters.centers(model, points), path, width=WIDTH)
    queries = spark.createDataFrame(
        [(f"q{i}", middles[i].tolist(), None) for i in range(12)], QUERIES
    )
    return queries, points, spark.read.parquet(path), clusters.centers(model, points)


def test_probing_all_clusters_is_exact(clustered):
    queries, points, stored, middles = clustered
    assert rows(stored.select("id")) == rows(points.select("id"))
    got = clusters.probe_top_k(queries, stored, middles, width=WIDTH, probes=12)
    assert rows(got) == rows(search.top_k(queries, points, width=WIDTH))


def test_probing_few_clusters_reads_few_partitions_and_keeps_recall(clustered):
    queries, points, stored, middles = clustered
    one = queries.filter("query_id IN ('q0', 'q5')")
    got = clusters.probe_top_k(one, stored, middles, width=WIDTH, probes=2)
    plan = plan_of(got)
    filters = plan[plan.index("PartitionFilters: [") :]
    assert "cluster" in filters[: filters.index("]") + 1]
    want = set(rows(search.top_k(one, points, width=WIDTH)))
    assert len(want & set(rows(got))) >= 0.9 * len(want)


def test_nearest_leaves_out_malformed_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [inf, 1.0]), (6, [1.0, 1.0]), (7, [1.0])]
    points = spark.createDataFrame(data, "id long, vector array<float>")
    query = F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")
    got = [r["id"] for r in search.nearest(points, query).collect()]
    assert got == [1, 6]


def test_cells_are_dealt_evenly(spark):
    """Twice as many cells as tasks: every task gets two, and no query or point is lost."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = [(i, search.POINTS, None, None, None, i, [1.0, float(i)]) for i in range(2 * partitions)]
    asked = [(i, search.QUERIES, f"q{i}", 1, [1.0, float(i)], None, None) for i in range(2 * partitions)]
    schema = "cell long, kind int, query_id string, limit int, query_vector array<double>, id long, vector array<double>"
    cells = spark.createDataFrame(points + asked, schema)
    query_schema = spark.createDataFrame([], QUERIES).schema
    hits = search.score_cells(cells, query_schema, 2, 0.9)
    assert rows(hits.select("query_id", "id")) == sorted((f"q{i}", i) for i in range(2 * partitions))
    held = hits.groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in held) == [2] * partitions


def test_tiles_of_scores_stay_small_and_lose_no_hit():
    rng = np.random.default_rng(7)
    queries, points = rng.normal(size=(1300, 16)), rng.normal(size=(3000, 16))
    points[1500:1540] = points[10]  # ties within a tile and across tiles
    limits = rng.integers(1, 6, len(queries))
    tracemalloc.start()
    top = block_scores.TopHits(queries, limits, 0.3)
    for low in range(0, len(points), 2000):
        top.add(np.arange(low, min(low + 2000, len(points))), points[low : low + 2000])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 8 << 20  # all scores of a batch are 10 MB
    scores = np.array([(points * q).sum(axis=1) for q in queries])
    scores /= np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(points, axis=1)
    want = set()
    for q, (row, limit) in enumerate(zip(scores.round(9), limits)):
        order = np.lexsort((np.arange(len(row)), -row))[:limit]
        want |= {(q, int(i)) for i in order if row[i] >= 0.3}
    assert set(zip(top.q.tolist(), top.ids.tolist())) == want


def test_grid_sends_few_rows():
    # a tall grid, one block of queries for all points, would send every query to each of 48 cells
    query_blocks, point_blocks = search.grid_shape(102_000, 513_000, 229_000, 48)
    assert query_blocks * point_blocks >= 48
    assert 102_000 * point_blocks + 513_000 * query_blocks < 0.65 * (102_000 * 48 + 513_000)
    assert search.grid_shape(0, 0, 10, 16)[0] == 1 and search.grid_shape(1000, 10, 10, 16)[0] >= 100


def test_many_query_blocks_take_turns(spark, monkeypatch):
    """Sixteen blocks of queries: no turn sends much more than the points and a block's queries."""
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(320, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    monkeypatch.setattr(sizing, "CELL_BYTES", 20 * (8 * sizing.NUMBER_BYTES + 3 * sizing.HIT_BYTES))
    monkeypatch.setattr(search, "ROUND_BYTES", 0)
    sent, old = [], search.score_cells
    monkeypatch.setattr(search, "score_cells", lambda cells, *a: (sent.append(cells.count()), old(cells, *a))[1])
    asked = spark.createDataFrame(rows, "query_id long, vector array<double>")
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    got = search.top_k(asked, points, width=8, limit=3, min_score=0.2, strategy="grid").orderBy("query_id", "rank").collect()
    units = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    scores = units @ units.T
    want = [(q, r + 1, int(i)) for q in range(320) for r, i in enumerate(np.argsort(-scores[q], kind="stable")[:3]) if scores[q, i] >= 0.2]
    assert [(h.query_id, h.rank, h.id) for h in got] == want
    assert len(sent) == 16 and max(sent) <= 320 + 60 * spark.sparkContext.defaultParallelism
