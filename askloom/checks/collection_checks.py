"""Point collections built from the documents and embeddings tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from askloom import fixed
from askloom.checks.registry import check, table
from askloom.checks.text_checks import LINES_SQL
from askloom.checks.vector_checks import WIDTH, points
from askloom.plans import scratch
from askloom.sources import aligned, buckets, collections
from askloom.sources.documents import chunk, read_documents
from askloom.sources.large_files import large_file_chunks

POINTS_SQL = f"""
SELECT ('0x' || substr(md5(c.doc_id || '/' || c.chunk_index), 1, 15))::BIGINT AS id, c.text, d.source, c.chunk_index,
       round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS norm
FROM ({LINES_SQL}) c JOIN documents d ON d.doc_id = c.doc_id
JOIN embeddings e ON e.vec_id = c.doc_id
"""

REJECTS_SQL = f"""
SELECT ('0x' || substr(md5(c.doc_id || '/' || c.chunk_index), 1, 15))::BIGINT AS id, c.text, d.source, c.chunk_index,
       NULL::DOUBLE AS norm
FROM ({LINES_SQL}) c JOIN documents d ON d.doc_id = c.doc_id
WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.doc_id)
"""


def chunk_id():
    """An id from both key columns: sixty bits of a hash of their text."""
    named = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def _chunks_and_vectors(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    chunks = chunk(documents, keys=("doc_id", "source"), delimiter="\n")
    vecs = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")
    )
    return chunks, chunks.select("doc_id", "chunk_index").join(vecs, "doc_id")


def _as_points(attached):
    return collections.as_points(attached, chunk_id(), source=F.col("source"), chunk_index=F.col("chunk_index"))


def _points(spark, sf_dir):
    return _as_points(collections.attach_vectors(*_chunks_and_vectors(spark, sf_dir)))


FILE_DOCUMENTS = 64  # neighbouring ids that make a part
FILE_BYTES = 16 << 20  # of neighbouring parts in one file, if all were of one source and of mean length


def _new_mark():
    """What begins a part in a file, as a boundary does in a mail; made anew, so that no text has it."""
    return f"{uuid.uuid4().hex}:"


def _write_parts(documents, path, mark, after):
    """Write ``documents`` as text files of a span of parts of a source, so that there are files
    by the size of the table and no folder and file for every few documents.

    A part is its mark and number, ``after``, and its texts by id, each with a line end.
    """
    mean = documents.agg(F.avg(F.octet_length("text"))).first()[0] or 1
    part, span = F.floor(F.col("doc_id") / FILE_DOCUMENTS), max(1, int(FILE_BYTES / (FILE_DOCUMENTS * mean)))
    texts = documents.select("source", part.alias("part"), F.floor(part / span).alias("span"), "doc_id", "text")
    texts = texts.withColumn("text", F.coalesce("text", F.lit("")))
    parts = texts.repartition("source", "span").groupBy("source", "span", "part")
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).getField("text").alias("texts"))
    number = F.coalesce(F.col("part").cast("string"), F.lit(""))
    whole = F.concat(F.lit(mark), number, F.lit(after), F.array_join("texts", "\n"))
    parts.select("source", "span", whole.alias("text")).write.partitionBy("source", "span").text(path)


def _part_number(text):
    return F.nullif(text, F.lit("")).cast("long")


def _flat(nested):
    return nested.select(
        "id",
        "payload.text",
        "payload.source",
        F.col("payload.chunk_index").cast("long").alias("chunk_index"),
        F.round("norm", 6).alias("norm"),
    )


@check(POINTS_SQL)
def points_build(spark, sf_dir):
    """Chunks meet vectors by ``(doc_id, chunk_index)`` and become nested points.

    Every chunk of a document carries the vector of the document; chunks of documents
    without one are in ``points_rejected``.
    """
    accepted, _ = collections.split_by_width(_points(spark, sf_dir), WIDTH)
    return _flat(accepted)


@check(POINTS_SQL)
def points_aligned(spark, sf_dir):
    """The same from chunk and vector tables in buckets, which join without a shuffle."""
    names = []
    for name, df in zip(("chunks", "vectors"), _chunks_and_vectors(spark, sf_dir)):
        names.append(f"{name}_{uuid.uuid4().hex}")
        aligned.write_aligned(df, names[-1], scratch.new_path(spark, name), 16)
    accepted, _ = collections.split_by_width(_as_points(aligned.attach_aligned(spark, *names)), WIDTH)
    return _flat(accepted)


@check(REJECTS_SQL)
def points_rejected(spark, sf_dir):
    """The chunks that ``points_build`` leaves, with a NULL norm."""
    _, rejected = collections.split_by_width(_points(spark, sf_dir), WIDTH)
    return _flat(rejected)


def _written(spark, sf_dir):
    path, rejects = scratch.new_path(spark, "collection"), scratch.new_path(spark, "rejects")
    collections.create_collection(_points(spark, sf_dir), path, WIDTH, rejects=rejects)
    return path, rejects


@check(POINTS_SQL)
def collection_written(spark, sf_dir):
    """The same points written as a collection and read back."""
    return _flat(spark.read.parquet(_written(spark, sf_dir)[0]))


@check(REJECTS_SQL)
def collection_rejects(spark, sf_dir):
    """What the same write puts on the rejects path, read back."""
    return _flat(spark.read.parquet(_written(spark, sf_dir)[1]))


@check("SELECT count(*) AS n_points FROM embeddings")
def count_points(spark, sf_dir):
    return collections.count_points(points(spark, sf_dir))


UPSERT_SQL = """
WITH fresh AS (
  SELECT vec_id * 2 AS id, 'new' AS origin, list_reverse(embedding) AS v FROM embeddings),
merged AS (
  SELECT * FROM fresh UNION ALL
  SELECT vec_id, 'old', embedding FROM embeddings
  WHERE vec_id NOT IN (SELECT id FROM fresh))
SELECT id, origin, i - 1 AS place, v[i]::DOUBLE AS value FROM merged, unnest(range(1, 65)) AS u(i)
"""


def _every_value(points):
    placed = points.select("id", "origin", F.posexplode("vector").alias("place", "value"))
    return placed.select("id", "origin", F.col("place").cast("long").alias("place"), F.col("value").cast("double").alias("value"))



@check(UPSERT_SQL)
def upsert_points(spark, sf_dir):
    """Half of the new ids replace old points, half are added; each comes in two versions."""
    old = points(spark, sf_dir).withColumn("origin", F.lit("old"))
    new = points(spark, sf_dir).select(
        (F.col("id") * 2).alias("id"),
        F.reverse("vector").alias("vector"),
        F.lit("new").alias("origin"),
        F.lit(2).alias("version"),
    )
    stale = new.withColumn("origin", F.lit("stale")).withColumn("version", F.lit(1))
    merged = collections.upsert(old, stale.unionByName(new), version="version")
    return _every_value(merged)


@check(
    """
WITH merged AS (
  SELECT vec_id * 2 AS id, 'b' AS origin, embedding AS v FROM embeddings
  UNION ALL SELECT vec_id, 'old', embedding FROM embeddings
  WHERE vec_id NOT IN (SELECT vec_id * 2 FROM embeddings))
SELECT id, origin, i - 1 AS place, v[i]::DOUBLE AS value FROM merged, unnest(range(1, 65)) AS u(i)
"""
)
def upsert_repeats(spark, sf_dir):
    """New points that come twice without a version: of equal ids the last content stays."""
    old = points(spark, sf_dir).withColumn("origin", F.lit("old"))
    new = points(spark, sf_dir).withColumn("id", F.col("id") * 2)
    twice = new.withColumn("origin", F.lit("a")).unionByName(new.withColumn("origin", F.lit("b")))
    merged = collections.upsert(old.select("id", "origin", "vector"), twice.select("id", "origin", "vector"))
    return _every_value(merged)


@check(UPSERT_SQL)
def upsert_in_buckets(spark, sf_dir):
    """The same upsert into a collection cut into buckets, read back in its new version."""
    path = scratch.new_path(spark, "buckets")
    buckets.create_buckets(points(spark, sf_dir).withColumn("origin", F.lit("old")), path, 16)
    new = points(spark, sf_dir).select(
        (F.col("id") * 2).alias("id"), F.reverse("vector").alias("vector"), F.lit("new").alias("origin"), F.lit(2).alias("version")
    )
    stale = new.withColumn("origin", F.lit("stale")).withColumn("version", F.lit(1))
    buckets.upsert_buckets(spark, path, stale.unionByName(new), version="version")
    return _every_value(buckets.read_buckets(spark, path))


@check(
    """
WITH lines AS (
  SELECT source, doc_id // 64 AS part, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents),
kept AS (SELECT *, trim(line, %s) AS text FROM lines WHERE NOT starts_with(line, '#'))
SELECT source, part, row_number() OVER (PARTITION BY source, part ORDER BY doc_id, line_no) - 1 AS chunk_index, text
FROM kept WHERE text <> ''
"""
    % ("'" + fixed.WHITESPACE.replace("'", "''") + "'")
)
def large_files(spark, sf_dir):
    """Documents written to files of many lines, each line a paragraph, and chunked in splits.

    A part begins with its mark as a paragraph, so chunks are counted from the mark before them."""
    path, mark = scratch.new_path(spark, "large-files"), _new_mark()
    doubled = F.concat(F.regexp_replace("text", "\n", "\n\n"), F.lit("\n"))
    _write_parts(table(spark, sf_dir, "documents").withColumn("text", doubled), path, mark, "\n\n")
    chunks = large_file_chunks(spark, f"{path}/*/*")
    begun = F.when(F.col("text").startswith(mark), F.struct(_part_number(F.substr("text", F.lit(len(mark) + 1))).alias("part"), "chunk_index"))
    before = Window.partitionBy("doc_id").orderBy("chunk_index")  # a file, of about FILE_BYTES at most
    placed = chunks.withColumn("begun", F.last(begun, ignorenulls=True).over(before))
    return placed.filter(~F.col("text").startswith(mark)).select(
        F.regexp_extract("doc_id", "/source=([^/]*)/", 1).alias("source"),
        F.col("begun.part").alias("part"),
        (F.col("chunk_index") - F.col("begun.chunk_index") - 1).cast("long").alias("chunk_index"),
        "text",
    )


@check(
    f"""
SELECT source, doc_id // {FILE_DOCUMENTS} AS part, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text
FROM documents GROUP BY ALL
"""
)
def read_files(spark, sf_dir):
    """Documents written as text files of a source's neighbouring ids, with equal file names
    in many folders, read back and cut into parts of ``FILE_DOCUMENTS`` ids at their marks."""
    path, mark = scratch.new_path(spark, "files"), _new_mark()
    _write_parts(table(spark, sf_dir, "documents"), path, mark, "\n")
    parts = F.split("text", mark)
    read = read_documents(spark, f"{path}/*/*").select(
        F.regexp_extract("doc_id", "/source=([^/]*)/", 1).alias("source"),
        F.explode(F.slice(parts, F.lit(2), F.size(parts) - 1)).alias("text"),
    )
    number = F.substring_index("text", "\n", 1)
    return read.select("source", _part_number(number).alias("part"), F.substr("text", F.length(number) + 2).alias("text"))


@check(
    """
SELECT vec_id AS id, (CASE WHEN label = 0 THEN 63 ELSE 64 END)::BIGINT AS width, label <> 0 AS accepted
FROM embeddings
"""
)
def width_check(spark, sf_dir):
    """Vectors of one label lose an element and go to the rejects."""
    mixed = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.slice("embedding", F.lit(1), F.when(F.col("label") == 0, 63).otherwise(64)).alias("vector"),
    )
    accepted, rejected = collections.split_by_width(mixed, WIDTH)
    both = accepted.withColumn("accepted", F.lit(True)).unionByName(
        rejected.withColumn("accepted", F.lit(False))
    )
    return both.select("id", F.size("vector").cast("long").alias("width"), "accepted")
