"""Chunking, previews and newline folding over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom import fixed
from askloom.checks.registry import check, table
from askloom.functions.text import clip, fold_newlines, preview
from askloom.sources.documents import chunk


def chunk_sql(text: str, delimiter: str) -> str:
    blanks = f"'{fixed.WHITESPACE}'"
    return f"""
WITH cut AS (
  SELECT doc_id, list_transform(
    list_filter(string_split({text}, {delimiter}),
                lambda p: length(trim(p, {blanks})) > 0 AND NOT starts_with(p, '#')),
    lambda p: trim(p, {blanks})) AS pieces
  FROM documents)
SELECT doc_id, i - 1 AS chunk_index, pieces[i] AS text
FROM cut, unnest(range(1, len(pieces) + 1)) AS u(i)
"""


def _long_index(chunks):
    return chunks.withColumn("chunk_index", F.col("chunk_index").cast("long"))


LINES_SQL = chunk_sql("text", "chr(10)")


@check(LINES_SQL)
def chunk_lines(spark, sf_dir):
    return _long_index(chunk(table(spark, sf_dir, "documents"), delimiter="\n"))


@check(
    chunk_sql(
        "replace(replace(replace(text, chr(10), repeat(chr(10), 3)), '. ', '.' || repeat(chr(10), 2)),"
        " ', ', repeat(chr(10), 2) || '#')",
        "repeat(chr(10), 2)",
    )
)
def chunk_paragraphs(spark, sf_dir):
    """Default delimiter on texts rewritten to hold paragraphs and headings."""
    lines = F.replace("text", F.lit("\n"), F.lit("\n\n\n"))
    sentences = F.replace(lines, F.lit(". "), F.lit(".\n\n"))
    headed = F.replace(sentences, F.lit(", "), F.lit("\n\n#"))
    documents = table(spark, sf_dir, "documents").select("doc_id", headed.alias("text"))
    return _long_index(chunk(documents))


@check(chunk_sql("text", "'. '"))
def chunk_sentences(spark, sf_dir):
    """A delimiter that is special in a regular expression."""
    return _long_index(chunk(table(spark, sf_dir, "documents"), delimiter=". "))


@check(
    """
SELECT doc_id, left(text, 100) || '...' AS preview, left(text, 80) || '...' AS short_preview,
       left(text, 200) AS clipped
FROM documents
"""
)
def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        preview("text").alias("preview"),
        preview("text", fixed.SHORT_PREVIEW_CHARS).alias("short_preview"),
        clip("text").alias("clipped"),
    )


@check("SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS text FROM documents")
def fold_document_newlines(spark, sf_dir):
    """Texts rewritten with CRLF and lone CR come back with LF."""
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    mixed = F.replace(crlf, F.lit(". "), F.lit(".\r"))
    return table(spark, sf_dir, "documents").select("doc_id", fold_newlines(mixed).alias("text"))
