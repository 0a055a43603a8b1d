"""Search over a collection laid out by cluster, approximate or exact.

Points are written in one partition per cluster of their directions. Angles obey the
triangle inequality, so a cluster whose points lie within an angle of its middle can hold no
point nearer to a query than the query's angle to the middle less that one. ``bounded_top_k``
scores first the cluster of the best bound for each query, takes the score of its last hit as the
query's floor, and then only the clusters whose bounds reach the floor: its result is that of
``search.top_k``. ``probe_top_k`` scores a fixed number of clusters and misses what lies in others.

Either way all queries and clusters of a round go through one job: a cluster is cut into
cells by a hash of the point id, so one that holds most of the points is scored by many tasks,
and so are the queries of a cluster that very many probe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from askloom import fixed
from askloom.functions.vectors import has_width
from askloom.operators import search
from askloom.operators.block_scores import matrix
from askloom.plans import scratch, sizing

CELL_POINTS = 1 << 16  # points of a cluster that one task scores
MARGIN = 1e-9  # of rounding in angles; bounds are wider by it
RADII = "cluster long, radius double, n long"


def fit_clusters(points: DataFrame, k: int, *, width: int, seed: int = 0) -> PipelineModel:
    """K-means over unit vectors. The driver holds ``k`` centers, never points.

    Fitting passes over ``points`` several times and may be given a part of a collection;
    the layout and the search always cover all of it.
    """
    return Pipeline(
        stages=[
            Normalizer(inputCol="__raw", outputCol="__unit"),
            KMeans(k=k, seed=seed, featuresCol="__unit", predictionCol="cluster"),
        ]
    ).fit(_with_raw(points.filter(has_width("vector", width))).select("__raw"))


def _with_raw(points: DataFrame) -> DataFrame:
    return points.withColumn("__raw", array_to_vector("vector"))


class _Middles:
    """All cluster middles as unit vectors, which every task holds."""

    def __init__(self, middles: DataFrame, width: int):
        table = middles.orderBy("id").toArrow()
        self.ids = np.array(table.column("id").to_pylist(), np.int64)
        rows = np.array(table.column("vector").to_pylist(), np.float64).reshape(len(self.ids), width)
        self.rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def cosines(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(rows @ self.rows.T / np.linalg.norm(rows, axis=1, keepdims=True), -1, 1)


def assigned(points: DataFrame, middles: DataFrame, *, width: int) -> DataFrame:
    """Add ``cluster``: the id of the middle with the greatest cosine, the lower of equals.

    Vectors of another width, which no search matches, get cluster -1. ``middles`` is the
    table ``id, vector`` of all centers, which every task holds.
    """
    held = _Middles(middles, width)
    fields = T.StructType([*points.schema.fields, T.StructField("cluster", T.LongType())])
    at = points.columns.index("vector")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, usable = matrix(batch.column(at), width)
            cluster = np.full(batch.num_rows, -1, np.int64)
            if len(usable):
                cluster[usable] = held.ids[np.argmax(held.cosines(found), axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster)], fields.names)

    return points.mapInArrow(placed, fields)


def write_clustered(points: DataFrame, middles: DataFrame, path: str, *, width: int) -> None:
    """Write ``id, vector`` points partitioned by the cluster of their nearest middle.

    Rows are spread by ranges of cluster and id, so a cluster with most of the points is
    written by many tasks into many files.
    """
    placed = assigned(points, middles, width=width)
    placed.repartitionByRange("cluster", "id").write.partitionBy("cluster").parquet(path)


def centers(model: PipelineModel, points: DataFrame) -> DataFrame:
    """The cluster centers as a small ``id, vector`` table."""
    rows = [(i, c.tolist()) for i, c in enumerate(model.stages[-1].clusterCenters())]
    return points.sparkSession.createDataFrame(rows, "id long, vector array<double>")


def radii(points: DataFrame, middles: DataFrame, *, width: int) -> DataFrame:
    """``cluster, radius, n``: the largest angle between a cluster's points and its middle.

    ``points`` is the table written by ``write_clustered``. Store the result with it.
    """
    held = _Middles(middles, width)

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, n = np.zeros(len(held.ids)), np.zeros(len(held.ids), np.int64)
        for batch in batches:
            rows, at = matrix(batch.column(0), width)
            own = np.searchsorted(held.ids, batch.column(1).to_numpy()[at])
            if len(at):
                angles = np.arccos(held.cosines(rows)[np.arange(len(at)), own])
                np.maximum.at(most, own, angles)
                np.add.at(n, own, 1)
        some = np.flatnonzero(n)
        columns = [held.ids[some], most[some], n[some]]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["cluster", "radius", "n"])

    usable = points.filter("cluster >= 0").select("vector", F.col("cluster").cast("long").alias("cluster"))
    found = usable.mapInArrow(widest, RADII)
    return found.groupBy("cluster").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))


def cluster_bounds(asked: DataFrame, middles: DataFrame, sizes: DataFrame, *, width: int, min_score: float) -> DataFrame:
    """``query_id, cluster, bound, n`` of the clusters that may hold a hit of a query.

    No point of the cluster has a greater cosine with the query than ``bound``.
    """
    held = _Middles(middles, width)
    found = {r["cluster"]: (r["radius"], r["n"]) for r in sizes.collect()}  # a row per center
    radius = np.array([found.get(i, (0.0, 0))[0] for i in held.ids.tolist()])
    n = np.array([found.get(i, (0.0, 0))[1] for i in held.ids.tolist()], np.int64)
    schema = T.StructType(
        [asked.schema["query_id"], *(T.StructField(c, k) for c, k in (("cluster", T.LongType()), ("bound", T.DoubleType()), ("n", T.LongType())))]
    )

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = matrix(batch.column(1), width)
            if not len(at):
                continue
            angle = np.maximum(np.arccos(held.cosines(rows)) - radius - MARGIN, 0)
            bound = np.cos(angle) + MARGIN
            q, c = np.nonzero((bound >= min_score) & (n > 0))
            columns = [batch.column(0).take(pa.array(at[q])), *map(pa.array, (held.ids[c], bound[q, c], n[c]))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return asked.select("query_id", "vector").mapInArrow(bounded, schema)


def _asked(queries: DataFrame, limit: int) -> DataFrame:
    own = F.col("limit") if "limit" in queries.columns else F.lit(None)
    named = queries.select("query_id", "vector", F.coalesce(own, F.lit(limit)).cast("int").alias("limit"))
    return named.filter("limit > 0")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch.new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score_pairs(asked: DataFrame, pairs: DataFrame, points: DataFrame, *, width: int, min_score: float) -> DataFrame:
    """Partial hits of every query in the clusters that ``pairs(query_id, cluster)`` gives it.

    One job for all: cells are cluster, part of its points and part of its queries.
    """
    most = asked.agg(F.max("limit")).first()[0] or 1
    block = sizing.query_rows(width, most, sizing.CELL_BYTES)
    probed = pairs.groupBy("cluster").agg(F.count("*").alias("queries"))
    held = points.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("points"))
    cut = probed.join(held, "cluster").select(  # a row per cluster
        "cluster",
        F.ceil(F.col("queries") / F.lit(block)).cast("int").alias("query_parts"),
        F.ceil(F.col("points") / F.lit(CELL_POINTS)).cast("int").alias("point_parts"),
    )
    cut = stored(cut, "cluster-cells")
    points = points.filter(F.col("cluster").isin([r["cluster"] for r in cut.select("cluster").collect()]))  # of few middles
    cut = F.broadcast(cut)

    def part(key: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(parts))

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    cell = F.xxhash64("cluster", "qp", "pp")
    empty = F.lit(None)
    query_rows = (
        pairs.select("query_id", "cluster").join(asked, "query_id").join(cut, "cluster")
        .withColumn("qp", part("query_id", "query_parts").cast("int")).withColumn("pp", every("point_parts"))
        .select(
            cell.alias("cell"), F.lit(search.QUERIES).alias("kind"), "query_id", "limit", F.col("vector").alias("query_vector"),
            empty.cast("long").alias("id"), empty.cast(points.schema["vector"].dataType).alias("vector"),
        )
    )
    point_rows = (
        points.select(F.col("id").cast("long").alias("id"), "vector", F.col("cluster").cast("long").alias("cluster")).join(cut, "cluster")
        .withColumn("pp", part("id", "point_parts").cast("int")).withColumn("qp", every("query_parts"))
        .select(
            cell.alias("cell"), F.lit(search.POINTS).alias("kind"), empty.cast(asked.schema["query_id"].dataType).alias("query_id"),
            empty.cast("int").alias("limit"), empty.cast(asked.schema["vector"].dataType).alias("query_vector"), "id", "vector",
        )
    )
    return search.score_cells(point_rows.unionByName(query_rows), asked.schema, width, min_score)


def bounded_top_k(
    queries: DataFrame,
    points: DataFrame,
    middles: DataFrame,
    sizes: DataFrame,
    *,
    width: int,
    limit: int = fixed.TOP_K,
    min_score: float = fixed.MIN_SCORE,
) -> DataFrame:
    """``search.top_k`` without scoring clusters that cannot hold a hit.

    ``points`` is the table written by ``write_clustered``, ``middles`` its centers and
    ``sizes`` its ``radii``, stored. Each query visits the cluster of its best bound, and
    then all those whose bounds reach its floor. How much that leaves out depends on how
    tight the clusters are; see ``scored_share``.
    """
    asked = _asked(queries, limit)
    first, second = _visits(asked, points, middles, sizes, width, min_score)[1:]
    hits = first.unionByName(score_pairs(asked, second, points, width=width, min_score=min_score))
    most = asked.agg(F.max("limit")).first()[0] or 1
    return search.rank_hits(hits, most)


def scored_share(
    queries: DataFrame, points: DataFrame, middles: DataFrame, sizes: DataFrame, *, width: int,
    limit: int = fixed.TOP_K, min_score: float = fixed.MIN_SCORE,
) -> DataFrame:
    """``scored, pairs``: how many pairs ``bounded_top_k`` scores, of how many there are."""
    asked = _asked(queries, limit)
    bounds, _, second = _visits(asked, points, middles, sizes, width, min_score)
    visited = bounds.filter("place = 1").select("n").unionByName(second.select("n"))
    scored = visited.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored"))
    total = sizes.agg(F.sum("n").alias("n")).scalar() * asked.agg(F.count("*")).scalar()
    return scored.select("scored", total.alias("pairs"))


def _visits(asked, points, middles, sizes, width, min_score):
    """Bounds with each query's order of clusters, hits in its first one, and the others to visit."""
    bounds = cluster_bounds(asked, middles, sizes, width=width, min_score=min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cluster")
    bounds = stored(bounds.withColumn("place", F.row_number().over(order)), "cluster-bounds")
    first = bounds.filter("place = 1")
    hits = stored(score_pairs(asked, first, points, width=width, min_score=min_score), "first-hits")
    most = asked.agg(F.max("limit")).first()[0] or 1
    last = search.rank_hits(hits, most).join(asked.select("query_id", "limit"), "query_id")
    floors = last.filter(F.col("rank") == F.col("limit")).select("query_id", F.col("score").alias("floor"))
    rest = bounds.filter("place > 1").join(floors, "query_id", "left")
    second = rest.filter(F.col("bound") >= F.coalesce("floor", F.lit(-1.0))).select("query_id", "cluster", "n")
    return bounds, hits, stored(second, "second-visits")


def probe_top_k(
    queries: DataFrame,
    points: DataFrame,
    middles: DataFrame,
    *,
    width: int,
    probes: int,
    limit: int = fixed.TOP_K,
    min_score: float = fixed.MIN_SCORE,
) -> DataFrame:
    """``search.top_k`` of every query on the ``probes`` clusters nearest to it.

    ``points`` is the table written by ``write_clustered``, ``middles`` its centers. All
    queries and clusters are scored by one job. Hits in clusters a query doesn't probe are
    missed: the caller chooses ``probes`` and should measure the recall against
    ``search.top_k``.
    """
    asked = _asked(queries, limit)
    nearest = search.top_k(asked.select("query_id", "vector"), middles, width=width, limit=probes, min_score=-1.0)
    pairs = stored(nearest.select("query_id", F.col("id").alias("cluster")), "probes")
    hits = score_pairs(asked, pairs, points, width=width, min_score=min_score)
    return search.rank_hits(hits, asked.agg(F.max("limit")).first()[0] or 1)
