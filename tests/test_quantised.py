"""Search on compressed points against the exact search."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.operators import quantised, search

WIDTH = 32


def vectors_of(spark, rows, name):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{name} long, vector array<float>")


def topical(rng, n, middles=40):
    """Vectors around some middles, as an encoder's are."""
    base = rng.normal(size=(middles, WIDTH))
    return base[rng.integers(middles, size=n)] + 0.6 * rng.normal(size=(n, WIDTH))


def setup(spark, rows, **options):
    points = vectors_of(spark, rows, "id").repartition(5)
    books = quantised.fit_books(points, width=WIDTH, parts=8, **options).cache()
    return points, books, quantised.encode(points, books, width=WIDTH).cache()


def recall(got, want):
    found = {(r.query_id, r.id) for r in got.collect()}
    exact = {(r.query_id, r.id) for r in want.collect()}
    return len(found & exact) / len(exact), found - exact


@pytest.mark.parametrize("cell", [quantised.CELL_POINTS, 100])
def test_recall(spark, monkeypatch, cell):
    monkeypatch.setattr(quantised, "CELL_POINTS", cell)
    rng = np.random.default_rng(3)
    rows = topical(rng, 4000)
    points, books, codes = setup(spark, rows, sample_rows=2000)
    asked = vectors_of(spark, rows[:400] + 0.1 * rng.normal(size=(400, WIDTH)), "query_id")
    want = search.top_k(asked, points, width=WIDTH, limit=10)
    got = quantised.quantised_top_k(asked, codes, points, books, width=WIDTH, limit=10)
    share, _ = recall(got, want)
    assert share >= 0.95
    exact = {(r.query_id, r.id): r.score for r in want.collect()}
    assert all(abs(exact[r.query_id, r.id] - r.score) < 1e-9 for r in got.collect() if (r.query_id, r.id) in exact)
    assert codes.select(F.max(F.octet_length("codes"))).first()[0] == 8  # of 128 bytes


def test_small_query_blocks_and_a_whole_shortlist(spark, monkeypatch):
    monkeypatch.setattr(quantised, "TABLE_BYTES", 1 << 17)
    rng = np.random.default_rng(4)
    rows = topical(rng, 300)
    points, books, codes = setup(spark, rows)
    asked = vectors_of(spark, rows[:60], "query_id")
    want = search.top_k(asked, points, width=WIDTH, limit=5)
    got = quantised.quantised_top_k(asked, codes, points, books, width=WIDTH, limit=5, shortlist=60)
    assert [tuple(r)[:3] for r in got.orderBy("query_id", "rank").collect()] == [tuple(r)[:3] for r in want.orderBy("query_id", "rank").collect()]


def test_copies_fall_to_the_lower_ids(spark):
    rng = np.random.default_rng(5)
    rows = topical(rng, 900)
    rows[::3] = rows[0]
    points, books, codes = setup(spark, rows)
    asked = vectors_of(spark, rows[:1], "query_id")
    got = quantised.quantised_top_k(asked, codes, points, books, width=WIDTH, limit=4, shortlist=2)
    assert [r.id for r in got.orderBy("rank").collect()] == [0, 3, 6, 9]


def test_odd_vectors_and_empty_tables(spark):
    rows = topical(np.random.default_rng(6), 50)
    odd = [(100, None), (101, [1.0]), (102, [float("nan")] * WIDTH), (103, [0.0] * WIDTH), (104, [None] + [1.0] * (WIDTH - 1))]
    points, books, codes = setup(spark, rows)
    odd_points = spark.createDataFrame(odd, "id long, vector array<float>")
    both = points.unionByName(odd_points)
    assert quantised.encode(odd_points, books, width=WIDTH).count() == 0
    asked = both.withColumnRenamed("id", "query_id")
    got = quantised.quantised_top_k(asked, codes, both, books, width=WIDTH)
    assert {r.query_id for r in got.collect()} == set(range(50))
    none = points.limit(0)
    no_books = quantised.fit_books(none, width=WIDTH, parts=8)
    assert no_books.count() == 0
    assert quantised.quantised_top_k(asked, codes.limit(0), points, no_books, width=WIDTH).count() == 0
    assert quantised.quantised_top_k(asked, codes.limit(0), points, books, width=WIDTH).count() == 0
    with pytest.raises(ValueError):
        quantised.fit_books(points, width=WIDTH, parts=5)


def test_shortlists_are_those_of_all_sums_in_less_time():
    rng = np.random.default_rng(8)
    rows = quantised._units(rng.normal(size=(1500, 64)))
    held = [rng.normal(size=(256, 4)).astype(np.float32) / 4 for _ in range(16)]
    codes = rng.integers(0, 256, (24_000, 16)).astype(np.uint8)
    codes[rng.permutation(24_000)[:6000]] = codes[0]  # copies, which fall to the lower ids
    ids = rng.permutation(24_000).astype(np.int64)
    tables = quantised._Tables(pa.array(range(1500)), rows, held, 60)
    began = time.thread_time()
    for low in range(0, 24_000, 8000):
        tables.add(ids[low : low + 8000], codes[low : low + 8000])
    took, began = time.thread_time() - began, time.thread_time()
    sums = tables.tables[0][:, codes[:, 0]]
    for i in range(1, 16):
        sums += tables.tables[i][:, codes[:, i]]
    assert took < time.thread_time() - began
    got = tables.hits(["query_id", "id", "rough"]).to_pydict()
    for q in range(0, 1500, 50):
        want = np.lexsort((ids, -sums[q]))[:60]
        assert got["id"][60 * q : 60 * q + 60] == ids[want].tolist()
        assert got["rough"][60 * q : 60 * q + 60] == sums[q, want].tolist()
