"""Chunks of documents that change: a log of what each load altered.

A load compares the chunks of its documents with those that the log holds for them, by hashes,
and logs only chunks that are new, differ or are gone; a chunk that is gone is a row without
a text (a tombstone). A document with a null text is deleted. The collection is the last row of every
chunk, without the tombstones, and equals a fresh build. Loads are folders of their own, so one
that is repeated replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from askloom import fixed
from askloom.functions.text import paragraphs

PLACE = ["doc_id", "chunk_index"]


def create_log(spark: SparkSession, path: str, doc_id: str = "long") -> None:
    """An empty log; ``doc_id`` is the type of document ids."""
    schema = f"doc_id {doc_id}, chunk_index int, hash binary, text string"
    spark.createDataFrame([], schema).write.parquet(f"{path}/load=-1")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, chunk_index, hash, text, load`` of all loads."""
    known = spark.read.parquet(f"{path}/load=-1").schema
    return spark.read.schema(known.add("load", T.LongType())).parquet(path)


def current_chunks(log: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, text`` as the loads have left them."""
    last = log.groupBy(*PLACE).agg(F.max_by(F.struct("text"), "load").alias("last"))
    return last.select(*PLACE, "last.text").filter("text IS NOT NULL")


def held_hashes(log: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``doc_id, held``: the hashes of a document's chunks in the log, by their index."""
    own = log.select(*PLACE, "hash", "load").join(doc_ids, "doc_id", "left_semi")
    last = own.groupBy(*PLACE).agg(F.max_by(F.struct("hash"), "load").getField("hash").alias("hash"))
    places = last.filter("hash IS NOT NULL").groupBy("doc_id")
    places = places.agg(F.array_sort(F.collect_list(F.struct("chunk_index", "hash"))).alias("places"))
    most = F.get("places", F.size("places") - 1)["chunk_index"]
    by_index = F.map_from_entries("places")
    spread = F.transform(F.sequence(F.lit(0), most), lambda i: F.try_element_at(by_index, i))
    held = F.when(F.size("places") == most + 1, F.col("places.hash")).otherwise(spread)
    return places.select("doc_id", held.alias("held"))


def chunk_changes(log: DataFrame, documents: DataFrame, *, delimiter: str = fixed.PARAGRAPH_DELIMITER) -> DataFrame:
    """The rows to log for ``documents``, a table with one row per ``doc_id``.

    The log is read without its texts, and only for these documents. A document meets its
    hashes as a whole, so that its texts stay where they were gathered by ``doc_id``.
    """
    chunks = F.coalesce(paragraphs("text", delimiter), F.array().cast("array<string>"))
    held = held_hashes(log, documents.select("doc_id"))
    both = documents.select("doc_id", chunks.alias("chunks")).join(held, "doc_id", "left")
    old = F.coalesce("held", F.array().cast("array<binary>"))
    both = both.select("doc_id", F.posexplode(F.arrays_zip(F.col("chunks"), old.alias("held"))).alias("chunk_index", "chunk"))
    both = both.select(*PLACE, F.col("chunk.chunks").alias("text"), F.col("chunk.held").alias("held"))
    both = both.withColumn("hash", F.unhex(F.sha2("text", 256)))
    return both.filter(~F.col("hash").eqNullSafe(F.col("held"))).select(*PLACE, "hash", "text")


def last_texts(documents: DataFrame, modified: str | None) -> DataFrame:
    """One row per document: of several the one of the greatest ``modified``, then text."""
    columns = ([modified] if modified else []) + ["text"]
    last = documents.groupBy("doc_id").agg(F.max(F.struct(*columns)).alias("last"))
    return last.select("doc_id", "last.text")


def log_load(
    spark: SparkSession, path: str, documents: DataFrame, load: int, *,
    modified: str | None = None, delimiter: str = fixed.PARAGRAPH_DELIMITER,
) -> None:
    """Log what ``documents(doc_id, text)`` change against all loads before ``load``."""
    before = read_log(spark, path).filter(F.col("load") < load)
    changed = chunk_changes(before, last_texts(documents, modified), delimiter=delimiter)
    changed.write.mode("overwrite").parquet(f"{path}/load={load}")
