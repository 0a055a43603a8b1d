"""Replies emitted once by a stream, and what its state holds."""

import json
import random

from conftest import rows
from pyspark.sql import functions as F

from askloom.operators import replies
from askloom.streaming import emitted

SCHEMA = "response_id string, seq long, line string, at timestamp"
OPTIONS = {"late": "1 minute", "silence": "10 minutes", "remember": "1 hour"}


def sse(tokens, stop=True):
    lines = ["data: " + json.dumps({"choices": [{"delta": {"content": t}}]}) for t in tokens]
    return lines + ["data: [DONE]", "data: " + json.dumps({"choices": [{"delta": {"content": "late"}}]})] * stop


class Feed:
    """Lines of some replies put into a watched folder in steps."""

    def __init__(self, spark, tmp_path):
        self.spark, self.source = spark, tmp_path / "in"
        self.source.mkdir()
        self.out, self.progress = str(tmp_path / "out"), str(tmp_path / "progress")
        self.steps = 0

    def add(self, records):
        """``records`` are ``(reply, seq, line, second)``."""
        self.steps += 1
        rows_ = [{"response_id": r, "seq": s, "line": x, "at": f"2026-01-01T00:{t // 60:02}:{t % 60:02}Z"} for r, s, x, t in records]
        hidden = self.source / f".{self.steps}"
        hidden.write_text("".join(json.dumps(r) + "\n" for r in rows_))
        hidden.rename(self.source / f"{self.steps}.json")
        arriving = self.spark.readStream.schema(SCHEMA).json(str(self.source))
        emitted.emit_replies(replies.sse_tokens(arriving), self.out, self.progress, **OPTIONS).awaitTermination()
        return rows(self.spark.read.parquet(self.out))

    def waiting(self):
        return rows(replies.reassemble(emitted.waiting_tokens(self.spark, self.progress)))

    def known(self):
        return dict(rows(emitted.remembered(self.spark, self.progress)))


def test_a_reply_ends_at_its_marker_once_all_lines_are_there(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    a, b = sse(["x", "y", "z"]), sse(["1", "2"])
    assert feed.add([("a", i, a[i], 0) for i in (4, 3, 1)] + [("b", i, x, 0) for i, x in enumerate(b)]) == [("b", "12", "stop")]
    assert feed.waiting() == [("a", "y")] and feed.known() == {"a": False, "b": True}
    got = feed.add([("a", 1, a[1], 1), ("a", 0, a[0], 1), ("b", 0, b[0], 1)])
    assert got == [("b", "12", "stop")] and feed.waiting() == [("a", "xy")]
    got = feed.add([("a", 2, a[2], 2), ("a", 2, a[2], 2), ("b", 1, b[1], 2)])
    assert got == [("a", "xyz", "stop"), ("b", "12", "stop")]
    assert feed.waiting() == [] and feed.known() == {"a": True, "b": True}


def test_a_silence_ends_a_reply_and_marks_are_forgotten(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    a = sse(["x", "y"], stop=False)
    assert feed.add([("a", 0, a[0], 0), ("a", 1, a[1], 5), ("c", 0, "data: no json", 0)]) == []
    assert feed.add([("t", 0, a[0], 10 * 60 + 59)]) == []  # the watermark is a minute behind
    got = feed.add([("t", 1, a[1], 12 * 60)])
    assert got == [("a", "xy", "silence"), ("c", "", "silence")]
    assert feed.known() == {"a": True, "c": True, "t": False}
    got = feed.add([("t", 2, a[1], 59 * 60 + 59)])
    assert [r[0] for r in got] == ["a", "c"] or [r[0] for r in got] == ["a", "c", "t"]


def test_shuffled_lines_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    feed = Feed(spark, tmp_path)
    lines = []
    for r in range(40):
        texts = sse([rng.choice(["a", "é", "", "\n"]) + str(i) for i in range(rng.randint(0, 30))])
        texts[rng.randrange(len(texts) - 2) if len(texts) > 2 else 0 :0] = [": note", "data: {broken", 'data: {"choices": []}']
        lines += [(f"r{r}", i, x, 0) for i, x in enumerate(texts)]
    everything = lines + rng.sample(lines, len(lines) // 3)
    rng.shuffle(everything)
    third = len(everything) // 3
    for low in range(0, len(everything), third):
        got = feed.add(everything[low : low + third])
    batch = spark.createDataFrame([(r, s, x) for r, s, x, _ in lines], "response_id string, seq long, line string")
    want = rows(replies.reassemble(replies.sse_tokens(batch)))
    assert [(r, c) for r, c, _ in got] == want and {e for *_, e in got} == {"stop"}
    assert feed.waiting() == []


def test_ranges():
    rng = random.Random(1)
    for _ in range(200):
        ranges, plain = emitted.Ranges(), set()
        for n in [rng.randrange(12) for _ in range(rng.randrange(15))]:
            assert ranges.add(n) == (n not in plain)
            plain.add(n)
        assert sorted(plain) == [n for a, b in zip(ranges.flat[::2], ranges.flat[1::2]) for n in range(a, b)]
        assert ranges.flat == sorted(set(ranges.flat))
        for low in range(12):
            for high in range(low + 1, 13):
                assert ranges.covers(low, high) == set(range(low, high)).issubset(plain)


def test_further_columns_stay(spark):
    lines = spark.createDataFrame([("a", 0, "{}", 5)], "response_id string, seq long, line string, at long")
    assert rows(replies.ndjson_tokens(lines).select("at", "token")) == [(5, "")]
    assert rows(replies.sse_tokens(lines).select("at", F.coalesce("token", F.lit("-")))) == [(5, "-")]


def test_tokens_of_one_arrival_share_a_state_element(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    n = emitted.PART_TOKENS + 3
    line = "data: " + json.dumps({"choices": [{"delta": {"content": "t"}}]})
    feed.add([("a", i, line, 0) for i in range(1, n + 1)] + [("b", i, line, 0) for i in range(5, 9)])
    held = emitted._state(spark, feed.progress, "parts").groupBy("key.response_id").count()
    assert rows(held) == [("a", 2), ("b", 1)]
    assert feed.waiting() == [("a", "t" * n), ("b", "tttt")]
