"""Text documents and their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from askloom import fixed
from askloom.functions.text import fold_newlines, paragraphs


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: its path as ``doc_id`` and its whole text, at most 2 GB."""
    return from_files(spark.read.text(path, wholetext=True))


def literal_documents(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Documents given in code; their ids are the list positions."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def from_files(files: DataFrame) -> DataFrame:
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "/")  # batch and stream differ in it
    return files.select(
        path.alias("doc_id"), fold_newlines("value").alias("text")
    )


def chunk(
    documents: DataFrame,
    *,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    delimiter: str = fixed.PARAGRAPH_DELIMITER,
) -> DataFrame:
    """Cut documents into ``keys, chunk_index, text`` with a dense 0-based index.

    Runs inside the scan stage: no shuffle, and only ``keys`` and the text are read.
    """
    return documents.select(
        *keys, F.posexplode(paragraphs(text, delimiter)).alias("chunk_index", "text")
    )
