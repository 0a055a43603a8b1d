"""Tables in buckets that join where they lie."""

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import rows
from askloom.sources import aligned, collections


@pytest.fixture
def tables(spark, tmp_path):
    """Chunks, of which one document has most, and vectors of some of them."""
    chunks = spark.range(3000).select(
        F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).cast("long").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"),
        F.concat(F.lit("text "), "id").alias("text"),
    )
    vectors = chunks.filter("chunk_index % 3 > 0").select("doc_id", "chunk_index", F.array(F.lit(1.0).cast("float")).alias("vector"))
    names = [f"{x}_{uuid.uuid4().hex}" for x in ("chunks", "vectors")]
    for name, df in zip(names, (chunks, vectors)):
        aligned.write_aligned(df, name, str(tmp_path / name), 8)
    yield chunks, vectors, names, tmp_path
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_aligned_tables_join_without_a_shuffle(spark, tables):
    chunks, vectors, names, _ = tables
    joined = aligned.attach_aligned(spark, *names)
    got = rows(joined.select("doc_id", "chunk_index", "text", "vector"))
    want = rows(collections.attach_vectors(chunks, vectors).select("doc_id", "chunk_index", "text", "vector"))
    assert [str(r) for r in got] == [str(r) for r in want] and len(got) == 3000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_a_document_of_most_chunks_fills_all_buckets(spark, tables):
    *_, names, folder = tables
    files = list((folder / names[0]).glob("*.parquet"))
    assert len(files) == 8
    held = [spark.read.parquet(str(f)).count() for f in files]
    assert sum(held) == 3000 and max(held) < 2 * min(held)
