"""Similarity, norms and top-k search over the embeddings table."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from askloom.checks.registry import check, table
from askloom.functions import vectors
from askloom.functions.scalars import round_score
from askloom.operators import clusters, quantised, search
from askloom.plans import scratch

WIDTH = 64


def points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )


def queries(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).withColumnRenamed("id", "query_id")


def shown(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id", round_score("score").alias("score")
    )


TOPK_SQL = """
WITH scored AS (
  SELECT q.vec_id AS query_id, p.vec_id AS id,
         list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings p),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM scored WHERE score >= 0.3)
SELECT query_id, rank, id, round(score, 4) AS score FROM ranked WHERE rank <= 3
"""


@check(TOPK_SQL)
def vector_topk(spark, sf_dir):
    """Every vector as a query against the whole table."""
    return shown(search.top_k(queries(spark, sf_dir), points(spark, sf_dir), width=WIDTH))


@check(TOPK_SQL)
def vector_topk_grid(spark, sf_dir):
    """The plan for query sets beyond the broadcast bound."""
    return shown(
        search.top_k(queries(spark, sf_dir), points(spark, sf_dir), width=WIDTH, strategy="grid")
    )


@check(
    """
WITH parts AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM parts GROUP BY label, i) GROUP BY label),
near AS (
  SELECT vec_id, label, row_number() OVER (
           PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, label) AS place
  FROM (SELECT vec_id, embedding FROM embeddings) CROSS JOIN means),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id AS id,
         list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score
  FROM near qn JOIN near pn ON qn.place <= 2 AND pn.place = 1 AND qn.label = pn.label
  JOIN embeddings q ON q.vec_id = qn.vec_id JOIN embeddings p ON p.vec_id = pn.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM scored WHERE score >= 0.3)
SELECT query_id, rank, id, round(score, 4) AS score FROM ranked WHERE rank <= 3
"""
)
def vector_topk_clustered(spark, sf_dir):
    """Search on a collection laid out by cluster: each query in the two nearest of ten.

    The middles are the means of the labelled vectors, which SQL can repeat.
    """
    clustered, middles = _clustered(spark, sf_dir)
    return shown(clusters.probe_top_k(queries(spark, sf_dir), clustered, middles, width=WIDTH, probes=2))


def _clustered(spark, sf_dir):
    path = scratch.new_path(spark, "clustered")
    middles = (
        table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("id"), F.posexplode("embedding").alias("i", "x"))
        .groupBy("id", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
    )
    clusters.write_clustered(points(spark, sf_dir), middles, path, width=WIDTH)
    return spark.read.parquet(path), middles


@check(TOPK_SQL)
def vector_topk_bounded(spark, sf_dir):
    """Exact search that leaves out clusters by the triangle inequality of angles."""
    clustered, middles = _clustered(spark, sf_dir)
    sizes = clusters.stored(clusters.radii(clustered, middles, width=WIDTH), "radii")
    return shown(clusters.bounded_top_k(queries(spark, sf_dir), clustered, middles, sizes, width=WIDTH))


@check(
    f"""
SELECT (SELECT count(*) FROM embeddings) AS queries, count(*) AS wanted, 0 AS wrong, TRUE AS nine_of_ten FROM ({TOPK_SQL})
"""
)
def quantised_recall(spark, sf_dir):
    """Every vector searched on codes of 16 bytes: how many hits there are, and whether nine of
    ten are found. ``wrong`` counts found ones that the exact search scores otherwise."""
    own = points(spark, sf_dir)
    books = clusters.stored(quantised.fit_books(own, width=WIDTH), "books")
    codes = clusters.stored(quantised.encode(own, books, width=WIDTH), "codes")
    asked = queries(spark, sf_dir)
    found = shown(quantised.quantised_top_k(asked, codes, own, books, width=WIDTH)).select("query_id", "id", F.col("score").alias("found"))
    both = shown(search.top_k(asked, own, width=WIDTH)).join(found, ["query_id", "id"], "left")
    share = F.count("found") >= 0.9 * F.count("*")
    counts = both.agg(F.count("*").alias("wanted"), F.count_if(F.col("found") != F.col("score")).alias("wrong"), share.alias("nine_of_ten"))
    return counts.select(F.lit(asked.count()).cast("long").alias("queries"), "wanted", "wrong", "nine_of_ten")


@check(
    """
WITH scored AS (
  SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score
  FROM embeddings WHERE vec_id % 3 <> 1)
SELECT id, round(score, 4) AS score FROM scored WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 3
"""
)
def nearest_malformed(spark, sf_dir):
    """One query on a table in which a third of the vectors hold a NaN or an infinity."""
    odd = F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))).cast("float")
    spoiled = F.concat(F.array(odd), F.slice("vector", 2, WIDTH))
    mixed = points(spark, sf_dir).withColumn("vector", F.when(F.col("id") % 3 == 1, spoiled).otherwise(F.col("vector")))
    query = points(spark, sf_dir).filter("id = 0").select("vector").scalar()
    norm = points(spark, sf_dir).filter("id = 0").select(vectors.norm("vector")).scalar()
    return search.nearest(mixed, query, query_norm=norm).withColumn("score", round_score("score"))


@check(
    """
WITH scored AS (
  SELECT q.vec_id AS query_id, CASE WHEN q.label < 9 THEN q.label % 5 ELSE 3 END AS most,
         p.vec_id AS id,
         list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings p),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM scored WHERE score >= 0.2)
SELECT query_id, rank, id, round(score, 4) AS score FROM ranked WHERE rank <= most
"""
)
def vector_topk_limits(spark, sf_dir):
    """Limits of 0 to 4 carried by the queries, some left to the default."""
    limited = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("vector"),
        F.when(F.col("label") < 9, F.col("label") % 5).alias("limit"),
    )
    return shown(search.top_k(limited, points(spark, sf_dir), width=WIDTH, min_score=0.2))


@check(
    """
WITH parts AS (
  SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x) AS m FROM parts GROUP BY i)),
scored AS (
  SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], mean.v) AS score
  FROM embeddings, mean)
SELECT id, round(score, 4) AS score FROM scored
WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 3
"""
)
def vector_nearest(spark, sf_dir):
    """One query: the mean of all vectors, as a scalar subquery."""
    all_points = points(spark, sf_dir)
    mean = all_points.select(
        vector_to_array(Summarizer.mean(array_to_vector("vector"))).alias("mean")
    )
    query = mean.select(F.struct("mean", vectors.norm("mean").alias("norm"))).scalar()
    hits = search.nearest(all_points, query["mean"], query_norm=query["norm"], min_score=0.2)
    return hits.select("id", round_score("score").alias("score"))


@check(
    """
SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm
FROM embeddings
"""
)
def vector_norms(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.round(vectors.norm("vector"), 6).alias("norm"))


@check(
    """
SELECT vec_id AS id, 'array<float>' AS type_name, len(embedding) AS width,
       round(embedding[1]::DOUBLE, 6) AS v1, round(embedding[2]::DOUBLE, 6) AS v2,
       round(embedding[3]::DOUBLE, 6) AS v3, round(embedding[4]::DOUBLE, 6) AS v4,
       round(embedding[5]::DOUBLE, 6) AS v5
FROM embeddings
"""
)
def vector_profile(spark, sf_dir):
    profiled = points(spark, sf_dir).select("id", *vectors.profile("vector"))
    firsts = [
        F.round(F.get("first_values", i).cast("double"), 6).alias(f"v{i + 1}") for i in range(5)
    ]
    return profiled.select("id", "type_name", F.col("width").cast("long").alias("width"), *firsts)


@check(
    """
SELECT a.vec_id AS id_a, b.vec_id AS id_b,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""
)
def pair_cosine(spark, sf_dir):
    """Similarity of given pairs: each vector and its successor."""
    a = points(spark, sf_dir).select(F.col("id").alias("id_a"), F.col("vector").alias("va"))
    b = points(spark, sf_dir).select(F.col("id").alias("id_b"), F.col("vector").alias("vb"))
    pairs = a.join(b, F.col("id_b") == F.col("id_a") + 1)
    return pairs.select("id_a", "id_b", round_score(vectors.cosine("va", "vb")).alias("score"))
