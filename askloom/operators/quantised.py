"""Approximate search on compressed points: product quantisation with exact scores at the end.

A unit vector is cut into ``parts`` pieces and each piece replaced by the number of its
nearest center in that piece's code book, so a point of 384 floats becomes a byte per part. A
query's scores with all centers are a small table; a point's rough score is the sum of
the entries its codes name, taken for the points that a block product finds near enough. Codes meet queries in cells cut by hashes, where the codes
stream past the tables of a query block. Per query ``shortlist`` times the limit best rough
scores are joined with the vectors and scored exactly, so only which points are looked at is
approximate, never a score: a hit is missed if its rough score falls behind the shortlist's.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from askloom import fixed
from askloom.functions import vectors
from askloom.functions.vectors import has_width
from askloom.operators import search
from askloom.operators.block_scores import matrix
from askloom.operators.clusters import stored

PARTS, CODES = 16, 256
SAMPLE_ROWS = 1 << 15  # vectors that the books are fitted on, at most
ROUNDS = 12
TABLE_BYTES = 64 << 20  # tables of a query block
CELL_POINTS = 1 << 20  # codes that one cell holds, about
TILE_SCORES = 1 << 18  # scores held at once in a tile, few enough for a core's cache
BOOKS = "part int, centers array<array<float>>"
QUERIES, POINTS = 0, 1


def _units(rows: np.ndarray) -> np.ndarray:
    return (rows / np.sqrt((rows * rows).sum(axis=1))[:, None]).astype(np.float32)


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row, the lower of equals."""
    return np.argmin((centers * centers).sum(axis=1) - 2 * (rows @ centers.T), axis=1)


def fit_books(points: DataFrame, *, width: int, parts: int = PARTS, codes: int = CODES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``part, centers``: a code book for every piece of a vector, at most ``codes`` (256) centers each.

    Fitted on the ``sample_rows`` vectors of the least id hashes, each book in a task of its
    own; all points are encoded with them. ``parts`` must divide ``width``. No vector that
    can be searched gives no books.
    """
    if width % parts or not 0 < codes <= 256:
        raise ValueError("parts must divide the width, and a code is a byte")
    usable = points.filter(has_width("vector", width) & (vectors.norm("vector") > 0))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("id", "vector")
    piece = width // parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("vector", i * piece + 1, F.lit(piece)))
    unit = F.transform("vector", lambda x: (x.cast("double") / F.col("norm")).cast("float"))
    sample = sample.withColumn("norm", vectors.norm("vector")).select("id", unit.alias("vector"))
    pieces = sample.select("id", F.posexplode(cut).alias("part", "piece"))

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        rows = table.column("piece").combine_chunks().flatten().to_numpy().reshape(-1, piece).astype(np.float32)
        centers = np.unique(rows, axis=0)
        centers = centers[np.random.default_rng(0).permutation(len(centers))[:codes]]
        for _ in range(ROUNDS):
            own = _nearest(rows, centers)
            n = np.bincount(own, minlength=len(centers))
            sums = np.stack([np.bincount(own, rows[:, i], len(centers)) for i in range(piece)], axis=1)
            centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers).astype(np.float32)
        part = table.column("part")[0].as_py()
        return pa.table({"part": pa.array([part], pa.int32()), "centers": pa.array([centers.tolist()], pa.list_(pa.list_(pa.float32())))})

    return pieces.groupBy("part").applyInArrow(fitted, BOOKS)


def _held(books: DataFrame) -> list[np.ndarray]:
    """All books, ``parts`` times at most 256 centers, as they go to every task."""
    return [np.array(r["centers"], np.float32) for r in books.orderBy("part").collect()]


def encode(points: DataFrame, books: DataFrame, *, width: int) -> DataFrame:
    """``id, codes`` of all points that can be searched: a byte per part. Store it."""
    held = _held(books)
    piece = width // max(1, len(held))

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = matrix(batch.column(1), width)
            rows = _units(rows)
            found = [_nearest(rows[:, i * piece : (i + 1) * piece], c) for i, c in enumerate(held)]
            data = np.stack(found, axis=1).astype(np.uint8) if held else np.zeros((0, 0), np.uint8)
            values = pa.array([r.tobytes() for r in data], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), values], ["id", "codes"])

    return points.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(coded, "id long, codes binary")


def _by_score(q: np.ndarray, rough: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by query, falling score and id; ids are looked at for equal scores only."""
    bits = (rough + np.float32(0)).view(np.uint32)
    rising = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
    key = q.astype(np.uint64) << np.uint64(32) | (~rising).astype(np.uint64)
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
    own = order[tied]
    order[tied] = own[np.lexsort((ids[own], key[own]))]
    return order


class _Tables:
    """Scores of a query block with all centers, and the best points of each query so far.

    A product of the queries with the vectors that codes stand for, in tiles that fit a core's
    cache, only tells which points can still get on a shortlist, with a margin above its
    rounding; their rough scores are the sums of the tables' entries, which equal codes give alike.
    """

    def __init__(self, names: pa.Array, rows: np.ndarray, held: list[np.ndarray], keep: int):
        piece = rows.shape[1] // len(held)
        self.names, self.keep, self.n = names, keep, len(rows)
        self.rows, self.held = rows, held
        self.tables = [rows[:, i * piece : (i + 1) * piece] @ c.T for i, c in enumerate(held)]
        # a unit vector times the one its code stands for, which is no longer than the longest centers of all parts
        longest = np.sqrt(sum(float((c.astype(np.float64) ** 2).sum(axis=1).max()) for c in held))
        self.margin = 2 * (rows.shape[1] + len(held) + 16) * 2.0**-23 * max(1.0, longest) * np.sqrt(rows.shape[1])
        self.ids = np.full((self.n, keep), np.iinfo(np.int64).max)
        self.rough = np.full((self.n, keep), -np.inf, np.float32)

    def add(self, ids: np.ndarray, codes: np.ndarray) -> None:
        if not len(ids) or not self.n:
            return
        points = np.concatenate([c[codes[:, i]] for i, c in enumerate(self.held)], axis=1)
        step = math.isqrt(TILE_SCORES)
        for low in range(0, self.n, step):
            q, p = self._candidates(slice(low, low + step), points, step)
            if len(q):
                q += low
                rough = self.tables[0][q, codes[p, 0]]
                for i in range(1, len(self.tables)):
                    rough += self.tables[i][q, codes[p, i]]
                self._keep(q, ids[p], rough)

    def _candidates(self, tile: slice, points: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries of the tile and points that may be among the best of each."""
        rows, floor, found = self.rows[tile], self.rough[tile, -1] - self.margin, []
        for low in range(0, len(points), step):
            near = rows @ points[low : low + step].T
            asked = np.flatnonzero(near.max(axis=1) >= floor)
            near = near[asked]
            mask = near >= floor[asked, None]
            crowded = np.flatnonzero(mask.sum(axis=1) > 2 * self.keep)
            if len(crowded):
                kth = np.partition(near[crowded], -self.keep, axis=1)[:, -self.keep]
                least = np.maximum(floor[asked[crowded]], kth - 2 * self.margin)
                mask[crowded] &= near[crowded] >= least[:, None]
                floor[asked[crowded]] = least
            q, p = np.nonzero(mask)
            found.append((asked[q], p + low))
        return tuple(map(np.concatenate, zip(*found)))

    def _keep(self, q: np.ndarray, ids: np.ndarray, rough: np.ndarray) -> None:
        """The ``keep`` best of each query, the lower ids of equal ones."""
        good = np.flatnonzero(rough >= self.rough[q, -1])
        q, ids, rough = q[good], ids[good], rough[good]
        held = np.unique(q)
        row, place = np.nonzero(self.rough[held] > -np.inf)
        q = np.concatenate([held[row], q])
        ids = np.concatenate([self.ids[held[row], place], ids])
        rough = np.concatenate([self.rough[held[row], place], rough])
        order = _by_score(q, rough, ids)
        q, ids, rough = q[order], ids[order], rough[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.keep
        self.ids[q[kept], rank[kept]] = ids[kept]
        self.rough[q[kept], rank[kept]] = rough[kept]

    def hits(self, names: list[str]) -> pa.RecordBatch:
        q, place = np.nonzero(self.rough > -np.inf)
        columns = [self.names.take(pa.array(q)), pa.array(self.ids[q, place]), pa.array(self.rough[q, place])]
        return pa.RecordBatch.from_arrays(columns, names)


def _shortlists(asked: DataFrame, codes: DataFrame, held: list[np.ndarray], width: int, keep: int) -> DataFrame:
    """``query_id, id, rough``: the best ``keep`` points of every query in every cell."""
    spark, n_parts = asked.sparkSession, len(held)
    block = max(1, TABLE_BYTES // (4 * (sum(map(len, held)) + width) + 12 * keep))
    n, m = asked.count(), codes.count()
    query_blocks, cells = max(1, -(-n // block)), max(1, -(-m // CELL_POINTS))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Few blocks of points, as every cell begins with empty shortlists; some cells for every core.
    point_blocks = max(cells, -(-4 * spark.sparkContext.defaultParallelism // query_blocks))

    def part(key: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    none = F.lit(None)
    query_rows = asked.withColumn("pb", every(point_blocks)).select(
        (F.col("pb") * query_blocks + part("query_id", query_blocks)).alias("cell"), F.lit(QUERIES).alias("kind"),
        "query_id", "vector", none.cast("long").alias("id"), none.cast("binary").alias("codes"),
    )
    point_rows = codes.withColumn("qb", every(query_blocks)).select(
        (part("id", point_blocks) * query_blocks + F.col("qb")).alias("cell"), F.lit(POINTS).alias("kind"),
        none.cast(asked.schema["query_id"].dataType).alias("query_id"), none.cast(asked.schema["vector"].dataType).alias("vector"), "id", "codes",
    )
    at = F.pmod(F.col("cell"), F.lit(partitions)).cast("int")  # in turn, as a hash would give some tasks several cells
    routed = query_rows.unionByName(point_rows).repartitionById(partitions, at).sortWithinPartitions("cell", "kind")
    schema = T.StructType([asked.schema["query_id"], T.StructField("id", T.LongType()), T.StructField("rough", T.FloatType())])

    def rough(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, tables = None, [], None
        for batch in batches:
            for at_cell, kind, run in search._runs(batch):
                if at_cell != cell:
                    if tables is not None:
                        yield tables.hits(schema.names)
                    cell, waiting, tables = at_cell, [], None
                if kind == QUERIES:
                    waiting.append(run)
                    continue
                if tables is None and waiting:
                    every_ = pa.Table.from_batches(waiting)
                    rows, at = matrix(every_.column("vector").combine_chunks(), width)
                    names = every_.column("query_id").combine_chunks().take(pa.array(at))
                    tables = _Tables(names, _units(rows), held, keep)
                if tables is not None:
                    own = np.frombuffer(b"".join(run.column("codes").to_pylist()), np.uint8).reshape(-1, n_parts)
                    tables.add(run.column("id").to_numpy(), own)
        if tables is not None:
            yield tables.hits(schema.names)

    return routed.mapInArrow(rough, schema)


def quantised_top_k(
    queries: DataFrame, codes: DataFrame, points: DataFrame, books: DataFrame, *, width: int,
    limit: int = fixed.TOP_K, min_score: float = fixed.MIN_SCORE, shortlist: int = 20,
) -> DataFrame:
    """``query_id, rank, id, score`` like ``search.top_k``, of the points that codes put on a shortlist.

    ``codes`` and ``books`` are the stored results of ``encode`` and ``fit_books``. Queries and
    points that can't be searched match nothing. ``shortlist`` times ``limit`` points a query
    are scored exactly; measure the recall against ``search.top_k`` when choosing it.
    """
    asked = queries.select("query_id", "vector").filter(has_width("vector", width) & (vectors.norm("vector") > 0))
    held = _held(books)
    schema = asked.schema["query_id"].dataType
    if not held or limit < 1:
        none = queries.sparkSession.createDataFrame([], "rank int, id long, score double")
        return none.select(F.lit(None).cast(schema).alias("query_id"), "rank", "id", "score")
    keep = shortlist * limit
    rough = _shortlists(asked, codes, held, width, keep)
    best = Window.partitionBy("query_id").orderBy(F.desc("rough"), "id")
    listed = rough.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep).select("query_id", "id")
    listed = stored(listed, "shortlists")
    vector = points.select(F.col("id").cast("long").alias("id"), F.col("vector").alias("__point"))
    both = listed.join(vector, "id").join(asked, "query_id")
    scored = both.select("query_id", "id", vectors.cosine("vector", "__point").alias("score"))
    return search.rank_hits(scored.filter(F.col("score") >= min_score).withColumn("limit", F.lit(limit)), limit)
