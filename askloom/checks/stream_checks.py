"""Streams run to the end of their input and read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from askloom.checks import reply_checks, session_checks
from askloom.checks.registry import check, table
from askloom.checks.text_checks import LINES_SQL, chunk_sql
from askloom.checks.vector_checks import TOPK_SQL, WIDTH, points, shown
from askloom.operators import replies
from askloom.plans import scratch
from askloom.plans.ordered import number_rows
from askloom.plans.skew import spread_join
from askloom.sources import changes, wire
from askloom.sources.replies import stream_lines
from askloom.streaming import emitted, jobs


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table, a file or a folder of files, as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a stream takes a file by pattern only


def _paths(spark, name):
    return scratch.new_path(spark, name), scratch.new_path(spark, name + "-progress")


@check(LINES_SQL)
def stream_chunks(spark, sf_dir):
    out, progress = _paths(spark, "chunks")
    jobs.ingest_chunks(
        stream(spark, sf_dir, "documents"), out, progress, delimiter="\n"
    ).awaitTermination()
    return spark.read.parquet(out).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@check(TOPK_SQL)
def stream_search(spark, sf_dir):
    out, progress = _paths(spark, "hits")
    asked = stream(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    jobs.search_stream(
        asked, points(spark, sf_dir), out, progress, width=WIDTH
    ).awaitTermination()
    return shown(spark.read.parquet(out))


@check(reply_checks.TEXT_SQL)
def stream_replies(spark, sf_dir):
    out, progress = _paths(spark, "tokens")
    schema_of = reply_checks.ndjson_lines(spark, sf_dir)
    lines_path = scratch.new_path(spark, "lines")
    schema_of.write.json(lines_path)
    lines = spark.readStream.schema(schema_of.schema).json(lines_path)
    jobs.ingest_tokens(lines, replies.ndjson_tokens, out, progress).awaitTermination()
    return replies.reassemble(spark.read.parquet(out))


@check(reply_checks.TEXT_SQL)
def stream_replies_late(spark, sf_dir):
    """Lines that arrive in two steps, later parts of replies first, a third of them twice."""
    out, progress = _paths(spark, "tokens")
    lines = reply_checks.ndjson_lines(spark, sf_dir)
    lines_path = scratch.new_path(spark, "lines")
    for late in (lines.filter("seq >= 5"), lines.filter("seq < 5 OR seq % 3 = 0")):
        late.write.mode("append").json(lines_path)
        arriving = stream_lines(spark, lines_path)
        jobs.ingest_tokens(arriving, replies.ndjson_tokens, out, progress).awaitTermination()
    return replies.reassemble(replies.once_each(spark.read.parquet(out)))


TIMED = "response_id string, seq long, line string, at timestamp"


def _arriving(spark, steps, emit):
    """Run ``emit`` on a folder of timed lines after each of ``steps`` has been added."""
    path = scratch.new_path(spark, "lines")
    for step in steps:
        step.write.mode("append").json(path)
        emit(spark.readStream.schema(TIMED).json(path)).awaitTermination()


def _timed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("at", F.timestamp_seconds(F.lit(1_767_225_600) + F.col("seq")))


@check(reply_checks.TEXT_SQL)
def stream_replies_emitted(spark, sf_dir):
    """Every reply once, at its stop marker: later parts come first, a third of the lines twice."""
    out, progress = _paths(spark, "replies")
    lines = _timed(reply_checks.sse_lines(spark, sf_dir))
    steps = (lines.filter("seq >= 5"), lines.filter("seq < 5 OR seq % 3 = 0"), lines.filter("seq % 4 = 0"))

    def emit(arriving):
        tokens = replies.sse_tokens(arriving)
        return emitted.emit_replies(tokens, out, progress, late="1 day", silence="2 days", remember="9 days")

    _arriving(spark, steps, emit)
    return spark.read.parquet(out).select("response_id", "content")


@check(reply_checks.TEXT_SQL)
def stream_replies_silent(spark, sf_dir):
    """Replies without stop markers, emitted when a much later line shows that they ended."""
    out, progress = _paths(spark, "replies")
    lines = _timed(reply_checks.ndjson_lines(spark, sf_dir))
    last = lines.agg(F.max("at").alias("at")).select(
        F.lit("later").alias("response_id"), F.lit(0).cast("long").alias("seq"), F.lit("{}").alias("line"),
        (F.col("at") + F.expr("INTERVAL 30 days")).alias("at"),
    )

    def emit(arriving):
        tokens = replies.ndjson_tokens(arriving)
        return emitted.emit_replies(tokens, out, progress, late="1 day", silence="2 days", remember="90 days")

    _arriving(spark, (lines.filter("seq % 2 = 1"), lines.filter("seq % 2 = 0"), last), emit)
    return spark.read.parquet(out).select("response_id", "content")


@check(session_checks.MEMORY_SQL + "SELECT session_id, position, role, content FROM memory")
def stream_sessions(spark, sf_dir):
    """Positions are counted on reading only, for the comparison with the batch form."""
    out, progress = _paths(spark, "sessions")
    messages = stream(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")
    )
    jobs.remember_sessions(messages, out, progress).awaitTermination()
    stored = spark.read.parquet(out)
    leads = stored.filter(F.col("part") == jobs.LEAD).groupBy("session_id").agg(F.count("*").alias("leads"))
    numbered = number_rows(stored, ["session_id", "part"], "at", F.lit(False))
    placed = spread_join(numbered, leads, "session_id", "left")
    before = F.when(F.col("part") == jobs.TURN, F.coalesce("leads", F.lit(0))).otherwise(0)
    return placed.select("session_id", (before + F.col("row_no") - 1).alias("position"), "role", "content")


BYTES = 1 << 20  # raw lines are ordered by bytes, of which a segment may hold many

WIRE_SQL = """
WITH placed AS (SELECT *, conv_id // 16 AS convs, turn // 64 AS turns FROM conversations)
SELECT convs, turns, row_number() OVER (PARTITION BY convs, turns ORDER BY conv_id, turn) - 1 AS reply, text AS content
FROM placed
"""


def _captured(spark, sf_dir, lines) -> DataFrame:
    """Raw lines in the order they came, by capture: 16 conversations, 64 turns of each."""
    placed = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.floor(F.col("conv_id") / 16).alias("convs"), F.floor(F.col("turn") / 64).alias("turns"),
        F.posexplode(lines(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0)))).alias("at", "line"),
    )
    ordered = placed.repartition("convs", "turns").sortWithinPartitions("convs", "turns", "conv_id", "turn", "at")
    line = F.when(F.col("at") % 2 == 0, F.concat("line", F.lit("\r"))).otherwise(F.col("line"))
    return ordered.select("convs", "turns", line.alias("line"))


def _ndjson_body(pieces):
    tokens = F.transform(pieces, lambda p: F.to_json(F.struct(p.alias("response"), F.lit(False).alias("done"))))
    return F.concat(F.array(F.lit(""), F.lit("not json")), tokens, F.array(F.lit('{"response": "", "done": true}')))


def _sse_body(pieces):
    def event(token):
        choice = F.struct(F.struct(token.alias("content")).alias("delta"))
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(choice).alias("choices"))))

    return F.concat(F.array(F.lit(": comment")), F.transform(pieces, event), F.array(F.lit(""), F.lit("data: [DONE]")))


def _contents(parted: DataFrame, tokens) -> DataFrame:
    named = parted.select(F.to_json(F.struct("path", "reply")).alias("response_id"), "seq", "line")
    whole = replies.reassemble(tokens(named), BYTES)
    path = F.get_json_object("response_id", "$.path")
    return whole.select(
        F.regexp_extract(path, "/convs=([0-9]+)/", 1).cast("long").alias("convs"),
        F.regexp_extract(path, "/turns=([0-9]+)/", 1).cast("long").alias("turns"),
        F.get_json_object("response_id", "$.reply").cast("long").alias("reply"),
        "content",
    )


@check(WIRE_SQL)
def wire_replies(spark, sf_dir):
    """Captured event streams, many replies end to end in a file, read in splits."""
    path = scratch.new_path(spark, "captures")
    _captured(spark, sf_dir, _sse_body).write.partitionBy("convs", "turns").text(path)
    return _contents(wire.part_replies(wire.read_wire(spark, f"{path}/*/*"), wire.sse_end()), replies.sse_tokens)


@check(WIRE_SQL)
def stream_wire(spark, sf_dir):
    """Captured NDJSON lines that arrive in two steps; the job is started again for the second."""
    path, (out, progress) = scratch.new_path(spark, "captures"), _paths(spark, "wire")
    lines = _captured(spark, sf_dir, _ndjson_body)
    for step in (lines.filter("convs % 2 = 0"), lines.filter("convs % 2 = 1")):
        step.write.partitionBy("convs", "turns").mode("append").text(path)
        jobs.append(wire.stream_wire(spark, f"{path}/*/*"), out, progress).awaitTermination()
    return _contents(wire.part_replies(spark.read.parquet(out), wire.ndjson_end()), replies.ndjson_tokens)


EDITED = "CASE WHEN doc_id % 3 = 0 THEN 'first' || chr(10) || text WHEN doc_id % 7 = 0 THEN NULL ELSE text END"


@check(chunk_sql(EDITED, "chr(10)"))
def stream_changes(spark, sf_dir):
    """All documents, and then edited, deleted and unchanged ones, logged by a stream: what is
    left of every document is what a fresh build gives."""
    arriving, (path, progress) = scratch.new_path(spark, "arriving"), _paths(spark, "chunk-log")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = documents.select("doc_id", F.expr(EDITED).alias("text"))
    changes.create_log(spark, path)
    for step in (documents, edited):
        step.write.mode("append").parquet(arriving)
        source = spark.readStream.schema("doc_id long, text string").parquet(arriving)
        jobs.follow_documents(source, path, progress, delimiter="\n").awaitTermination()
    chunks = changes.current_chunks(changes.read_log(spark, path))
    return chunks.withColumn("chunk_index", F.col("chunk_index").cast("long"))
