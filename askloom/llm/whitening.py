"""Whitening of embeddings: rows projected on the principal axes and scaled to unit variance.

Entries become integers, so sums and products of centred entries are exact whatever the
order of tasks. Each task sends one total; the driver sees ``width * width`` numbers and
never a row. Spark reads the vectors for their widths, sums, products, the reported error and
the result, and nothing but totals is shuffled.

Eigenvectors are first taken in single precision and then corrected by matrix products in
extended precision (Ogita and Aishima's iteration, whose error squares every round).
Eigenvalues that are closer than the present error form a cluster; within one the iteration
cannot turn vectors, so the matrix restricted to the cluster, shifted by its mean eigenvalue
and scaled, is solved the same way on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# How an entry becomes an integer, and how many components are returned.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
MOST = float(1 << 46)  # scaled entries beyond this can't be summed exactly and count as malformed
FLAT = 2.0**-50  # eigenvalues below this share of the largest count as no variance
ROUNDS = 12
LONG = (1 << 63) - 1

SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)
TOTALS = pa.list_(pa.decimal128(38, 0))


def refined(a: np.ndarray, x: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of symmetric ``a`` from approximate vectors ``x``.

    The arithmetic is that of ``a``. Differences between eigenvalues up to ``floor`` are
    taken as none.
    """
    x = x.astype(a.dtype)
    one = np.eye(len(a), dtype=a.dtype)
    tiny = np.finfo(a.dtype).eps
    scale = np.sqrt((a * a).sum())
    for _ in range(ROUNDS):
        r, s = one - x.T @ x, x.T @ (a @ x)
        s = (s + s.T) / 2  # else rounding, divided by a small gap, bends right angles
        values = np.diag(s) / (1 - np.diag(r))
        error = np.sqrt(((s - np.diag(values)) ** 2).sum()) + scale * np.sqrt((r * r).sum())
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= 2 * error
        x = x + x @ np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
        if error <= 4 * len(a) * tiny * scale:
            break
        x = turned(a, x, float(2 * error), max(floor, 8 * float(tiny * scale)))
    for _ in range(2):  # right angles again, where the last change was large for small gaps
        x = x + x @ (one - x.T @ x) / 2
    return np.diag(x.T @ (a @ x)) / np.diag(x.T @ x), x


def turned(a: np.ndarray, x: np.ndarray, near: float, floor: float) -> np.ndarray:
    """``x`` with the vectors of each cluster turned to the solution of its own problem."""
    values = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    for cluster in np.split(order, cuts):
        if len(cluster) == 1:
            continue
        own = x[:, cluster]
        part = own.T @ (a @ own) - values[cluster].mean() * (own.T @ own)
        part = (part + part.T) / 2
        size = np.abs(part).max()
        if size > floor:
            x[:, cluster] = own @ eigen(part / size, floor / float(size))[1]
    return x


def eigen(a: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and the vectors of a symmetric matrix, in its own precision."""
    scale = np.abs(a).max()
    if not scale:
        return np.diag(a).copy(), np.eye(len(a), dtype=a.dtype)
    _, x = np.linalg.eigh((a / scale).astype(np.float32))
    values, x = refined(a, x, floor)
    order = np.argsort(values, kind="stable")
    return values[order], x[:, order]


def exact_quotients(numerators: list[int], denominator: int) -> np.ndarray:
    """Quotients in extended precision: a double and what it leaves."""
    high = [n / denominator for n in numerators]
    low = [float(Fraction(n, denominator) - Fraction(h)) for n, h in zip(numerators, high)]
    return np.array(high, np.longdouble) + np.array(low, np.longdouble)


@dataclass
class Whitening:
    """What the fit list says: integers, and per component its variance and scaled axis."""

    n: int
    shift: np.ndarray  # long, per dimension: near the mean
    rest: list[int]  # sums less n times the shift
    variances: np.ndarray  # falling
    trace: float
    axes: np.ndarray  # width x components, divided by the standard deviation; 0 if there is none

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of squares of ``n * x - S``; null beyond a long."""
        z = x - self.shift
        most = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.rest))
        if most * most * z.shape[1] <= LONG:
            u = z * self.n - np.array(self.rest, np.int64)
            return pa.array((u * u).sum(axis=1), pa.int64())
        sums = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest)) for row in z.tolist()]
        return pa.array([s if s <= LONG else None for s in sums], pa.int64())


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's vectors, all of one width, as one row."""
    total = None
    for batch in batches:
        if len(batch):
            x = matrix(batch.column(0), len(batch.column(0)[0]))
            total = (0 if total is None else total) + x.sum(axis=0).astype(object)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([[int(v) for v in total]], TOTALS)], ["totals"])


def products(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` in Python's integers; doubles do where they are exact."""
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < 1 << 53:
        real = z.astype(np.float64)
        return (real.T @ real).astype(np.int64).astype(object)
    step = z.astype(object)
    return step.T @ step


def product_batches(batches: Iterator[pa.RecordBatch], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        if len(batch):
            total = total + products(matrix(batch.column(0), len(shift)) - shift)
    if isinstance(total, np.ndarray):
        yield pa.RecordBatch.from_arrays([pa.array([[int(v) for v in total.ravel()]], TOTALS)], ["totals"])


def error_batches(batches: Iterator[pa.RecordBatch], fit: Whitening) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        w = fit.centred(matrix(batch.column(0), len(fit.shift))) @ fit.axes
        w = np.concatenate((w, np.ones((len(w), 1))), axis=1)
        total = w.T @ w if total is None else total + w.T @ w
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["totals"])


def white_batches(
    batches: Iterator[pa.RecordBatch], fit: Whitening, error: float | None
) -> Iterator[pa.RecordBatch]:
    k = fit.axes.shape[1]
    has = fit.variances > 0
    for batch in batches:
        x = matrix(batch.column(1), len(fit.shift))
        w = fit.centred(x) @ fit.axes
        n = len(x)
        every = np.repeat(np.arange(n), k)
        explained = fit.variances / fit.trace if fit.trace else np.full(k, np.nan)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(every)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, fit.n)),
                fit.deviations(x).take(pa.array(every)),
                pa.array(w.ravel(), mask=np.tile(~has, n)),
                pa.array(np.tile(explained, n), from_pandas=True),
                pa.array([error] * (n * k), pa.float64()),
            ],
            [c.split()[0] for c in SCHEMA.split(", ")],
        )


def totals_of(df: DataFrame, kind: str) -> list:
    """Sums over the rows of an array column ``totals``, place by place."""
    places = df.select(F.posexplode("totals")).groupBy("pos").agg(F.sum(F.col("col").cast(kind)).alias("sum"))
    return [r["sum"] for r in sorted(places.collect())]


def whole_entries(vector: Column) -> Column:
    """The entries as integers; null for a vector that has one without a whole part."""
    entries = vector.cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * SCALE) >= MOST))
    return F.when(~bad & (F.size(entries) > 0), F.transform(entries, lambda c: F.floor(c * SCALE) + OFFSET))


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole_entries(F.col(vector)).alias("x"))
    return named.filter("x IS NOT NULL")


def fit_whitening(rows: DataFrame, width: int, n: int, sums: list[int], components: int) -> Whitening:
    """From rows ``x`` of one width with their number and sums."""
    shift = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, shift)]
    moved = np.array(shift, np.int64)
    held = totals_of(
        rows.select("x").mapInArrow(lambda b: product_batches(b, moved), "totals array<decimal(38,0)>"), "decimal(38,0)"
    )
    square = [n * int(held[i * width + j]) - rest[i] * rest[j] for i in range(width) for j in range(width)]
    covariance = exact_quotients(square, n * n).reshape(width, width)
    values, vectors = eigen(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    has = values > FLAT * max(values[0], 0)
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(len(values))])
    axes = np.where(has, vectors / np.sqrt(np.where(has, values, 1)), 0)
    return Whitening(n, moved, rest, np.where(has, values, 0).astype(float), float(np.trace(covariance)), axes.astype(float))


def identity_error(rows: DataFrame, fit: Whitening) -> float | None:
    """Largest entry by which the whitened rows' covariance differs from the identity."""
    has = fit.variances > 0
    if not has.any():
        return None
    found = rows.select("x").mapInArrow(lambda b: error_batches(b, fit), "totals array<double>")
    size = fit.axes.shape[1] + 1
    held = np.array(totals_of(found, "double")).reshape(size, size) / fit.n
    mean = held[-1, :-1]
    covariance = (held[:-1, :-1] - np.outer(mean, mean))[np.ix_(has, has)]
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(
    spark: SparkSession, vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Rows of ``SCHEMA``: one per vector and component.

    Vectors that are null, empty, or hold a null, a non-finite entry or one whose scaled size is
    ``MOST`` or more are left out, and so are those of another width than the most
    frequent one (of equally frequent ones, the widest). A null id stays null, repeated rows
    count as often as they occur, an empty table gives no rows, other columns are ignored.
    A component without variance has a null ``whitened`` and is left out of the error, which is
    null if no component has any; ``explained`` is null if nothing varies; a
    ``deviation`` beyond a long is null. The driver holds ``width * width`` numbers.
    """
    rows = integer_vectors(vectors, vec_id, vector)
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    usual = widths.agg(F.max(F.struct("n", "width")).alias("usual")).first()["usual"]
    if usual is None:
        return spark.createDataFrame([], SCHEMA)
    n, width = usual
    rows = rows.filter(F.size("x") == width)
    sums = totals_of(rows.select("x").mapInArrow(sum_batches, "totals array<decimal(38,0)>"), "decimal(38,0)")
    fit = fit_whitening(rows, width, n, [int(s) for s in sums], components)
    error = identity_error(rows, fit)
    return rows.select("vec_id", "x").mapInArrow(lambda b: white_batches(b, fit, error), SCHEMA)
