"""Whitening against exact covariances, and the eigenvectors of hard matrices."""

import math
from fractions import Fraction

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from askloom.llm import whitening

REAL = np.longdouble


def rotation(rng, n):
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    q = q.astype(REAL)
    for _ in range(3):  # orthonormal in extended precision
        q = q @ (3 * np.eye(n, dtype=REAL) - q.T @ q) / 2
    return q


SPECTRA = {
    "apart": lambda n: np.arange(1, n + 1) ** 2,
    "geometric": lambda n: 0.5 ** np.arange(n),
    "cluster": lambda n: np.concatenate((1 + 1e-9 * np.arange(n - 3), [2, 3, 5])),
    "two clusters": lambda n: np.concatenate((1 + 1e-10 * np.arange(n // 2), 2 + 1e-8 * np.arange(n - n // 2))),
    "tight": lambda n: 1 + 1e-13 * np.arange(n),
    "equal": lambda n: np.concatenate((np.ones(n - 2), [4, 4])),
    "one value": lambda n: np.ones(n),
    "low rank": lambda n: np.concatenate((np.zeros(n - 4), [1, 2, 2 + 1e-9, 3])),
}


@pytest.mark.parametrize("name", sorted(SPECTRA))
def test_eigenvectors(name):
    rng = np.random.default_rng(5)
    n = 24
    q, wanted = rotation(rng, n), np.sort(SPECTRA[name](n).astype(REAL))
    a = (q * SPECTRA[name](n).astype(REAL)) @ q.T
    a = (a + a.T) / 2
    values, x = whitening.eigen(a)
    size = np.abs(wanted).max()
    assert np.abs(values - wanted).max() <= 1e-17 * size
    assert np.abs(x.T @ x - np.eye(n)).max() <= 1e-17
    assert np.abs(a @ x - x * values).max() <= 2e-17 * size
    # single precision alone, and doubles on clusters, are far from this
    _, single = np.linalg.eigh(a.astype(np.float32))
    if name == "apart":
        assert np.abs(a @ single - single * values).max() > 1e-9 * size


def test_nothing_to_turn():
    for a in (np.zeros((3, 3), REAL), np.diag(np.array([3, 1, 2], REAL)), np.ones((1, 1), REAL)):
        values, x = whitening.eigen(a)
        assert np.abs(a @ x - x * values).max() <= 1e-18 and np.abs(x.T @ x - np.eye(len(a))).max() <= 1e-18


def covariance(rows):
    n, width = len(rows), len(rows[0])
    means = [Fraction(sum(r[j] for r in rows), n) for j in range(width)]
    z = [[v - m for v, m in zip(r, means)] for r in rows]
    return [[sum(r[i] * r[j] for r in z) / n for j in range(width)] for i in range(width)], z


def whole(vector):
    return [math.floor(64 * c) + 1_000_000 for c in vector]


def checked(got, given, k):
    """All rows of ``got`` against exact arithmetic; ``given`` are the vectors that count."""
    rows = [whole(v) for _, v in given]
    v, z = covariance(rows)
    n, width = len(rows), len(rows[0])
    sums = [sum(r[j] for r in rows) for j in range(width)]
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert len(got) == len(given) * k and {r.n for r in got} == {n}
    real = np.array([[float(x) for x in row] for row in v])
    values, vectors = np.linalg.eigh(real)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(sum(v[i][i] for i in range(width)))
    for (vec_id, _), x, y in zip(given, rows, z):
        for c in range(k):
            for r in by_id[vec_id][c + 1]:
                assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
                assert abs(r.explained - values[c] / trace) <= 1e-9 * r.explained
    signs = {}
    for (vec_id, _), y in zip(given, z):
        for c in range(k):
            want = float(np.array([float(a) for a in y]) @ vectors[:, c]) / math.sqrt(values[c])
            r = by_id[vec_id][c + 1][0]
            if abs(want) > 1e-3:
                signs.setdefault(c, np.sign(want * r.whitened))
            assert abs(r.whitened - signs.get(c, 1) * want) < 1e-8 * max(1, abs(want)), (c, want)
    white = np.array([[by_id[i][c + 1][0].whitened for c in range(k)] for i, _ in given])
    error = np.abs(np.cov(white.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert {r.identity_error for r in got} == {got[0].identity_error} and abs(got[0].identity_error - error) < 1e-11
    assert got[0].identity_error < 1e-12


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((40, 40)) * np.geomspace(1, 0.01, 40)
    good = [(i, np.float32(rng.standard_normal(40) @ mix + 3).tolist()) for i in range(400)]
    good += [(1000 + i, good[0][1]) for i in range(200)]  # a third of the rows are equal
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * 39 + [None], [nan] * 40, [inf] + [0.0] * 39, [1.0] * 39, [-inf] * 40, [3e38] * 40]
    rows = [(i, v, 1) for i, v in good] + [(2000 + i, v, 1) for i, v in enumerate(bad)]
    vectors = table(spark, rows).repartition(5).withColumns({"component": F.lit("c"), "n": F.lit(1), "x": F.lit(2)})
    got = whitening.whiten(spark, vectors).collect()
    checked(got, good, 32)


def test_few_dimensions_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(x) for x in rng.integers(-9, 9, 3)]) for i in range(50)]
    checked(whitening.whiten(spark, table(spark, [(*r, 0) for r in good])).collect(), good, 3)
    twice = whitening.whiten(spark, table(spark, [(*r, 0) for r in good + [(None, good[0][1])] * 2])).collect()
    assert len(twice) == 52 * 3 and sum(r.vec_id is None for r in twice) == 6 and {r.n for r in twice} == {52}


def test_nothing_varies_and_empty_table(spark):
    got = whitening.whiten(spark, table(spark, [(i, [1.0, 2.0], 0) for i in range(5)])).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in got} == {(None, None, None, 0)} and len(got) == 10
    flat = whitening.whiten(spark, table(spark, [(i, [float(i), 2.0, float(i)], 0) for i in range(5)])).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1}
    assert whitening.whiten(spark, table(spark, [])).collect() == []
    assert whitening.whiten(spark, table(spark, [(1, None, 0)])).columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")]


def test_large_entries_are_exact(spark):
    """Deviations on both sides of a long's range, and products beyond a double's."""
    for size in (2**18, 2**34):
        rows = [(i, [float(i * size), float(-i * 2 * size + 5), 1.0 + i * i], 0) for i in range(-20, 20)]
        doubles = table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
        got = whitening.whiten(spark, doubles).collect()
        x = [whole(v) for _, v, _ in rows]
        sums = [sum(c) for c in zip(*x)]
        want = {i: sum((40 * a - s) ** 2 for a, s in zip(r, sums)) for (i, _, _), r in zip(rows, x)}
        assert {r.vec_id: r.deviation for r in got} == {i: d if d < 2**63 else None for i, d in want.items()}
        v, _ = covariance(x)
        values = np.linalg.eigvalsh(np.array([[float(c) for c in row] for row in v]))
        assert abs(got[0].explained - values[-1] / values.sum()) < 1e-12


def test_tasks_send_totals_only(spark):
    plan = whitening.whiten(spark, table(spark, [(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 0)]))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
