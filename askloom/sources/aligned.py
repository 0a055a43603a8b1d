"""Chunk and vector tables cut into buckets alike, so that they join where they lie.

Both tables are bucketed by document and chunk, not by document alone, so that one with very
many chunks fills all buckets. Rows are dealt by the bucket function before they are
written, so a bucket is one file; joining two such tables on their keys shuffles nothing, however
often it is done. Bucketed tables need a catalog; their files lie at the path given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askloom.sources.collections import attach_vectors

KEYS = ("doc_id", "chunk_index")


def write_aligned(df: DataFrame, name: str, path: str, n_buckets: int, keys: tuple[str, ...] = KEYS) -> None:
    """Write ``df`` as the table ``name`` in ``n_buckets`` buckets by ``keys``.

    Tables that are to be joined need equal numbers of buckets and keys of equal types. An
    existing table is an error.
    """
    dealt = df.repartition(n_buckets, *keys)
    dealt.write.option("path", path).bucketBy(n_buckets, *keys).sortBy(*keys).saveAsTable(name)


def attach_aligned(spark: SparkSession, chunks: str, vectors: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``collections.attach_vectors`` of two tables that ``write_aligned`` wrote."""
    return attach_vectors(spark.table(chunks), spark.table(vectors).hint("merge"), keys)
