"""Raw reply files, read in splits and as streams."""

import pytest
from pyspark.sql import functions as F

from askloom.operators import replies
from askloom.sources import wire
from askloom.streaming import jobs


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def capture(folder, name, texts, end="\n"):
    lines = []
    for text in texts:
        lines += ["", ": note", *(f'data: {{"choices": [{{"delta": {{"content": "{c}"}}}}]}}' for c in text), "data: [DONE]"]
    (folder / name).write_bytes(end.join([*lines, ""]).encode())
    return lines


def in_order(df):
    return [r.line for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_in_order_at_small_splits(spark, tmp_path, small_splits, end):
    want = {name: capture(tmp_path, name, texts, end) for name, texts in {"a": ["one", "é" * 60], "b": ["x"] * 40}.items()}
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "long").write_text("y" * 1000 + "\nlast without end")
    want["long"] = ["y" * 1000, "last without end"]
    found = wire.read_wire(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    assert found.select("path", "start").distinct().count() > 10
    for name, lines in want.items():
        own = found.filter(F.col("name") == name)
        assert in_order(own) == lines and own.select("seq").distinct().count() == len(lines)
    assert {r.name for r in found.collect()} == set(want)


def test_replies_end_to_end(spark, tmp_path, small_splits):
    texts = ["one", "", "three é", "w" * 50, "last"]
    capture(tmp_path, "a", texts)
    parted = wire.part_replies(wire.read_wire(spark, str(tmp_path)), wire.sse_end())
    named = parted.select(F.col("reply").cast("string").alias("response_id"), "seq", "line")
    got = {int(r.response_id): r.content for r in replies.reassemble(replies.sse_tokens(named), 64).collect()}
    assert got == dict(enumerate(texts))


def test_stream_goes_on_after_a_restart(spark, tmp_path, small_splits):
    folder, out, progress = (tmp_path / x for x in ("in", "out", "progress"))
    folder.mkdir()
    want = []
    for name in ("a", "b"):
        want += capture(folder, name, ["first", "second"])
        jobs.append(wire.stream_wire(spark, str(folder)), str(out), str(progress)).awaitTermination()
    read = spark.read.parquet(str(out))
    assert [r.line for r in read.orderBy("path", "seq").collect()] == want
    batch = wire.read_wire(spark, str(folder))  # whose splits may be others
    assert [r.line for r in batch.orderBy("path", "seq").collect()] == want


def test_end_marks(spark):
    lines = spark.createDataFrame([('{"done": true}',), ('{"done": false}',), ("bad",), ("data: [DONE] ",), ("data:[DONE]",), (None,)], "line string")
    got = [tuple(r) for r in lines.select(wire.ndjson_end(), wire.sse_end()).collect()]
    assert got == [(True, False), (False, False), (False, False), (False, True), (False, False), (False, False)]
