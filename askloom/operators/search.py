"""Top-k cosine search with a score threshold.

``nearest`` answers one query, ``top_k`` many. The threshold is applied before the
limit, equal scores are ordered by id, and a zero or malformed vector never matches.

``top_k`` scores every query with every point, which is what an exact search has to
do, but never builds those pairs as rows: tasks multiply blocks and emit at most
``limit`` hits per query, and a ranked shuffle of those partial hits finishes the job.

* Few queries (within ``sizing.BROADCAST_BYTES``): the query block goes to every task
  and the points are scanned in place, without a shuffle.
* More queries: queries are hashed into blocks of ``sizing.CELL_BYTES``, points into
  blocks, and both are sent to the cells of the resulting grid. Cells are cut by a hash
  of the id, so no key, source or group of copies makes one cell larger than the others,
  and into as many blocks of either side as send the fewest rows.
  Points stream through a cell, so only the query block counts for its memory; large
  query blocks keep the copies of each point few.
* So many queries that a grid would send every row ``ROUND_COPIES`` times: the query blocks take
  turns, each scanning the points anew. Only its hits are kept of a turn, so the disk
  follows the tables, not the product of both. Store points that are dear to compute.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from askloom import fixed
from askloom.functions import vectors
from askloom.operators.block_scores import TopHits, matrix
from askloom.plans import scratch, sizing

ROUND_COPIES = 2  # of all rows, that a grid sends at once
ROUND_BYTES = 256 << 20  # of vectors, that it sends at once in any case
POINTS, QUERIES = 1, 0


def nearest(
    points: DataFrame,
    query: Column,
    *,
    limit: int = fixed.TOP_K,
    min_score: float = fixed.MIN_SCORE,
    query_norm: Column | None = None,
    norm: Column | None = None,
) -> DataFrame:
    """Best points for one query vector, as ``id, score`` in rank order.

    ``query`` may be a literal array or a scalar subquery. Pass norms that are known.
    The threshold follows the limit here, which keeps the same rows because both use the
    score, and lets Spark compute each score once.
    """
    query_norm = vectors.norm(query) if query_norm is None else query_norm
    columns = [F.col("id"), F.col("vector"), query.alias("__query"), query_norm.alias("__norm")]
    if norm is not None:
        columns.append(norm.alias("norm"))
    known = None if norm is None else F.col("norm")
    score = vectors.cosine("vector", "__query", norm_a=known, norm_b=F.col("__norm"))
    return (
        points.select(*columns)
        .select("id", score.alias("score"))
        .orderBy(F.desc("score"), F.asc("id"))
        .limit(limit)
        .filter(F.col("score") >= min_score)
    )


def top_k(
    queries: DataFrame,
    points: DataFrame,
    *,
    width: int = fixed.VECTOR_WIDTH,
    limit: int = fixed.TOP_K,
    min_score: float = fixed.MIN_SCORE,
    strategy: str = "auto",
) -> DataFrame:
    """Best points per query, as ``query_id, rank, id, score``.

    ``queries`` holds ``query_id, vector`` and optionally its own ``limit`` (NULL
    means the default); ``points`` holds ``id, vector``. ``strategy`` is "auto",
    "broadcast" or "grid".
    """
    own = F.col("limit") if "limit" in queries.columns else F.lit(None)
    asked = queries.select(
        "query_id", "vector", F.coalesce(own, F.lit(limit)).cast("int").alias("limit")
    ).filter("limit > 0")
    points = points.select(F.col("id").cast("long").alias("id"), "vector")

    table = None if strategy == "grid" else _broadcast_table(asked, width)
    if table is not None:
        partial, most = _scan_with_block(table, asked.schema, points, width, min_score)
    elif strategy == "broadcast":
        raise ValueError("the queries exceed the broadcast bound; use the grid")
    else:
        return _grid(asked, points, width, min_score)
    return rank_hits(partial, most)


def _broadcast_table(asked: DataFrame, width: int) -> pa.Table | None:
    """The queries, if their vectors and hits stay within the broadcast bound."""
    rows = sizing.query_rows(width, 0, sizing.BROADCAST_BYTES)
    table = sizing.small_table(asked, rows, sizing.BROADCAST_BYTES)
    if table is None:
        return None
    most = pc.max(table.column("limit")).as_py() or 0
    fits = sizing.query_rows(width, most, sizing.BROADCAST_BYTES)
    return table if table.num_rows <= fits else None


def rank_hits(hits: DataFrame, most: int) -> DataFrame:
    """Number partial hits per query and keep each query's own limit.

    ``most`` is the largest limit in use. As a literal bound it lets Spark cut the
    groups before the shuffle as well.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .filter((F.col("rank") <= most) & (F.col("rank") <= F.col("limit")))
        .select("query_id", "rank", "id", "score")
    )


def _hit_schema(query_schema: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_schema["query_id"].dataType),
            T.StructField("limit", T.IntegerType()),
            T.StructField("id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _column(data: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    column = data.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class _Block:
    """The usable query vectors of one block, keyed back to their query ids."""

    def __init__(self, keys: pa.Array, vecs: pa.Array, limits: pa.Array, width: int):
        rows, at = matrix(vecs, width)
        self.rows = rows
        self.keys = keys.take(pa.array(at))
        self.limits = limits.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(int)

    def hits(self, top: TopHits) -> pa.RecordBatch:
        picked = pa.array(top.q)
        return pa.RecordBatch.from_arrays(
            [
                self.keys.take(picked),
                pa.array(self.limits[top.q], pa.int32()),
                pa.array(top.ids, pa.int64()),
                pa.array(top.scores, pa.float64()),
            ],
            names=["query_id", "limit", "id", "score"],
        )


def _scan_with_block(table, schema, points, width, min_score):
    columns = [_column(table, name) for name in ("query_id", "vector", "limit")]
    shared = points.sparkSession.sparkContext.broadcast(columns)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(*shared.value, width)
        top = TopHits(block.rows, block.limits, min_score)
        for batch in batches:
            rows, at = matrix(batch.column("vector"), width)
            top.add(batch.column("id").to_numpy(zero_copy_only=False)[at], rows)
        yield block.hits(top)

    most = pc.max(columns[2]).as_py() or 0
    return points.mapInArrow(score, _hit_schema(schema)), most


def grid_shape(n_queries: int, n_points: int, block_rows: int, cells: int) -> tuple[int, int]:
    """Blocks of queries and of points for at least ``cells`` cells, with the fewest rows sent.

    Every query goes to all blocks of points and every point to all blocks of queries. A block
    of queries holds at most ``block_rows``.
    """
    least = max(1, math.ceil(n_queries / block_rows))
    shapes = [(blocks, math.ceil(cells / blocks)) for blocks in range(least, max(least, cells) + 1)]
    return min(shapes, key=lambda shape: (n_queries * shape[1] + n_points * shape[0], shape[0]))


def turns(n_queries: int, n_points: int, width: int, block_rows: int, cells: int) -> int:
    """In how many turns the queries meet the points: one, unless a grid sends too many copies."""
    query_blocks, point_blocks = grid_shape(n_queries, n_points, block_rows, cells)
    sent = n_queries * point_blocks + n_points * query_blocks
    most = max(ROUND_COPIES * (n_queries + n_points), ROUND_BYTES // (width * sizing.NUMBER_BYTES))
    return math.ceil(n_queries / block_rows) if sent > most else 1


def _grid(asked: DataFrame, points: DataFrame, width: int, min_score: float) -> DataFrame:
    spark = asked.sparkSession
    n_queries, most = asked.agg(F.count("*"), F.coalesce(F.max("limit"), F.lit(0))).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_rows = sizing.query_rows(width, most, sizing.CELL_BYTES)
    n_points = points.count()
    n = turns(n_queries, n_points, width, block_rows, 2 * partitions)
    if n == 1:
        shape = grid_shape(n_queries, n_points, block_rows, 2 * partitions)
        return rank_hits(_cell_hits(asked, points, width, min_score, shape), most)
    # A block has a cell for every core, so that the copies of its queries stay few as well.
    shape = 1, spark.sparkContext.defaultParallelism
    turn, path = F.pmod(F.xxhash64("query_id", F.lit(n)), F.lit(n)), scratch.new_path(spark, "hits")
    for i in range(n):
        own = rank_hits(_cell_hits(asked.filter(turn == i), points, width, min_score, shape), most)
        hits = scratch.written(own, path, "append")
    return hits


def _cell_hits(asked: DataFrame, points: DataFrame, width: int, min_score: float, shape: tuple[int, int]) -> DataFrame:
    query_blocks, point_blocks = shape

    def block_of(key: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    key_type = asked.schema["query_id"].dataType
    query_rows = asked.withColumn("pb", every(point_blocks)).select(
        (F.col("pb") * query_blocks + block_of("query_id", query_blocks)).alias("cell"),
        F.lit(QUERIES).alias("kind"),
        "query_id",
        "limit",
        F.col("vector").alias("query_vector"),
        F.lit(None).cast("long").alias("id"),
        F.lit(None).cast(points.schema["vector"].dataType).alias("vector"),
    )
    point_rows = points.withColumn("qb", every(query_blocks)).select(
        (block_of("id", point_blocks) * query_blocks + F.col("qb")).alias("cell"),
        F.lit(POINTS).alias("kind"),
        F.lit(None).cast(key_type).alias("query_id"),
        F.lit(None).cast("int").alias("limit"),
        F.lit(None).cast(asked.schema["vector"].dataType).alias("query_vector"),
        "id",
        "vector",
    )
    return score_cells(query_rows.unionByName(point_rows), asked.schema, width, min_score)


def score_cells(
    cells: DataFrame, query_schema: T.StructType, width: int, min_score: float
) -> DataFrame:
    """Partial hits of every cell: its query rows first, then its points as a stream."""
    # An explicit count keeps AQE from merging small but compute-heavy partitions.
    partitions = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Cells are dealt in turn, as a hash would give some tasks several times the cells of others.
    at = F.pmod(F.col("cell"), F.lit(partitions)).cast("int")
    routed = cells.repartitionById(partitions, at).sortWithinPartitions("cell", "kind")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, block, top = None, [], None, None
        for batch in batches:
            for at_cell, kind, part in _runs(batch):
                if at_cell != cell:
                    if top is not None:
                        yield block.hits(top)
                    cell, waiting, block, top = at_cell, [], None, None
                if kind == QUERIES:
                    waiting.append(part)
                    continue
                if top is None and waiting:
                    asked = pa.Table.from_batches(waiting)
                    names = ("query_id", "query_vector", "limit")
                    block = _Block(*(_column(asked, name) for name in names), width)
                    top = TopHits(block.rows, block.limits, min_score)
                if top is not None:
                    rows, at = matrix(part.column("vector"), width)
                    top.add(part.column("id").to_numpy(zero_copy_only=False)[at], rows)
        if top is not None:
            yield block.hits(top)

    return routed.mapInArrow(score, _hit_schema(query_schema))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Cut a sorted batch where its cell or row kind changes."""
    cells = batch.column("cell").to_numpy(zero_copy_only=False)
    kinds = batch.column("kind").to_numpy(zero_copy_only=False)
    changed = (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])
    edges = [0, *(np.flatnonzero(changed) + 1), len(cells)]
    for low, high in zip(edges, edges[1:]):
        if high > low:
            yield int(cells[low]), int(kinds[low]), batch.slice(low, high - low)
