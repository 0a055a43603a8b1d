"""Streams fed in several steps give what the batch form gives on all of it."""

import json
import os
import shutil

import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from askloom.checks import CHECKS
from askloom.operators import replies, search, sessions
from askloom.sources.documents import from_files
from askloom.sources.replies import stream_lines
from askloom.streaming import jobs


def drop(folder, name, records):
    """Put a file into a watched folder in one move."""
    hidden = folder / f".{name}"
    hidden.write_text("".join(json.dumps(r) + "\n" for r in records))
    os.rename(hidden, folder / name)


def test_chunks_of_new_files_only(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()

    def run():
        files = spark.readStream.format("text").option("wholetext", True).load(str(source))
        jobs.ingest_chunks(from_files(files), out, progress).awaitTermination()

    (source / "a.txt").write_bytes(b"one\r\n\r\ntwo")
    run()
    (source / "b.txt").write_bytes(b"# head\n\nthree")
    run()
    run()
    assert rows(spark.read.parquet(out)) == [
        (f"{source}/a.txt", 0, "one"),
        (f"{source}/a.txt", 1, "two"),
        (f"{source}/b.txt", 0, "three"),
    ]


def test_tokens_arriving_in_two_steps_and_twice(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    lines = [{"response_id": "r", "seq": i, "line": json.dumps({"response": str(i)})} for i in range(10)]

    def run():
        arriving = stream_lines(spark, str(source))
        jobs.ingest_tokens(arriving, replies.ndjson_tokens, out, progress).awaitTermination()

    drop(source, "1.json", lines[6:] + lines[:3])
    run()
    drop(source, "2.json", lines[2:7])
    run()
    stored = replies.once_each(spark.read.parquet(out))
    assert stored.count() == 10
    assert rows(replies.reassemble(stored)) == [("r", "0123456789")]


def test_queries_arriving_in_two_steps(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    points = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "id long, vector array<float>")
    schema = "query_id long, vector array<float>"
    queries = [{"query_id": i, "vector": [float(i), 1.0]} for i in range(8)]

    def run():
        arriving = spark.readStream.schema(schema).json(str(source))
        jobs.search_stream(arriving, points, out, progress, width=2).awaitTermination()

    drop(source, "1.json", queries[:5])
    run()
    drop(source, "2.json", queries[5:])
    run()
    got = spark.read.parquet(out).drop("batch")
    want = search.top_k(spark.createDataFrame([(q["query_id"], q["vector"]) for q in queries], schema), points, width=2)
    assert rows(got) == rows(want)


def test_sessions_growing_in_two_steps(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    schema = "session_id string, turn long, role string, content string"
    log = [
        {"session_id": s, "turn": t, "role": "user" if t % 2 == 0 else "assistant", "content": f"{s}{t}"}
        for s in "ab"
        for t in range(9)
    ]

    def run():
        arriving = spark.readStream.schema(schema).json(str(source))
        jobs.remember_sessions(arriving, out, progress).awaitTermination()

    drop(source, "1.json", [m for m in log if m["turn"] < 4])
    run()
    drop(source, "2.json", [m for m in log if m["turn"] >= 4])
    run()
    listed = Window.partitionBy("session_id").orderBy("part", "at")
    got = spark.read.parquet(out).select(
        "session_id", (F.row_number().over(listed) - 1).alias("position"), "role", "content"
    )
    batch = spark.createDataFrame([tuple(m.values()) for m in log], schema)
    want = sessions.session_memory(batch).select("session_id", "position", "role", "content")
    assert rows(got) == rows(want)


def test_session_totals_as_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    drop(source, "1.json", [{"session_id": "a", "role": "user"}, {"session_id": "a", "role": "assistant"}])
    arriving = spark.readStream.schema("session_id string, role string").json(str(source))
    query = (
        jobs.session_totals(arriving)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("totals")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert rows(spark.table("totals")) == [("a", 1, 2)]


@pytest.mark.parametrize("files", [1, 3])
def test_registered_streams_read_tables_of_one_file_and_of_many(spark, tmp_path, files):
    docs = [(i, f"first {i}\n# heading\n\nlast {i}") for i in range(20)]
    vecs = [(i, [float(i % 4 == j % 4) for j in range(64)]) for i in range(8)]
    turns = [(i // 4, i % 4, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(16)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string"),
        "embeddings": spark.createDataFrame(vecs, "vec_id long, embedding array<float>"),
        "conversations": spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"),
    }
    for name, df in tables.items():
        folder = str(tmp_path / (f"{name}.parquet" if files > 1 else f"{name}-parts"))
        df.repartition(files).write.parquet(folder)
        if files == 1:
            (part,) = (tmp_path / f"{name}-parts").glob("*.parquet")
            shutil.copy(part, tmp_path / f"{name}.parquet")
    run = lambda name: rows(CHECKS[name].run(spark, str(tmp_path)))
    assert len(run("stream_chunks")) == 40 and run("stream_chunks") == run("chunk_lines")
    assert len(run("stream_search")) == 16 and run("stream_search") == run("vector_topk")
    memory = rows(CHECKS["session_memory"].run(spark, str(tmp_path)).select("session_id", "position", "role", "content"))
    assert run("stream_sessions") == memory and len(memory) == 24
