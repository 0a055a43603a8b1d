import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from askloom import fixed
from askloom.operators import replies
from askloom.sources.replies import read_lines

LINES = "response_id string, seq long, line string"


# line, its token; None if the line is skipped
NDJSON = [
    ('{"response":"x"}', "x"),
    ('{"response": "é\\n\\"q\\" \\ud83d\\ude00"}', 'é\n"q" 😀'),
    ("{}", ""),
    ('{"response":null}', ""),
    ("bad", None),
    ("", None),
    (" ", None),
    ('{"response":"x"} junk', None),
    ('{"response":"a","response":"b"}', "b"),
    ("{'response':'x'}", None),
    ("[1]", None),
    ("5", None),
    ('{"response":"no end"', None),
    ('{"other":NaN,"response":"n"}', "n"),
]
STOP = object()
SSE = [
    ('data: {"choices":[{"delta":{"content":"x"}}]}', "x"),
    ('data: {"choices":[{"delta":{"content":"é  "}}],"id":1}', "é  "),
    ('data: {"choices":[{"delta":{}}]}', ""),
    ('data: {"choices":[{"delta":{"content":null}}]}', ""),
    ('data: {"choices":[]}', None),
    ('data: {"choices":[{}]}', None),
    ("data: {}", None),
    ('data:{"choices":[{"delta":{"content":"no"}}]}', None),
    ('event: {"choices":[{"delta":{"content":"no"}}]}', None),
    ("data: bad", None),
    ("", None),
    ("data: [DONE]", STOP),
    ("data:  [DONE] ", STOP),
]


@pytest.mark.parametrize("size", [3, 4096])
def test_replies_join_the_expected_tokens(spark, size):
    rng = random.Random(9)
    for parse, pool in [(replies.ndjson_tokens, NDJSON), (replies.sse_tokens, SSE)]:
        logged = {f"r{i}": rng.choices(pool, k=rng.randint(1, 30)) for i in range(150)}
        data = [(r, s, line) for r, lines in logged.items() for s, (line, _) in enumerate(lines)]
        rng.shuffle(data)
        want = []
        for r, lines in logged.items():
            tokens = [token for _, token in lines]
            upto = tokens.index(STOP) if STOP in tokens else len(tokens)
            want.append((r, "".join(filter(None, tokens[:upto]))))
        assert rows(replies.reassemble(parse(spark.createDataFrame(data, LINES)), size)) == sorted(want)


def test_one_long_reply_is_split_before_it_is_joined(spark):
    lines = spark.range(20000).select(
        F.lit("hot").alias("response_id"),
        F.col("id").alias("seq"),
        F.concat(F.lit('{"response":"'), F.col("id").cast("string"), F.lit(' "}')).alias("line"),
    )
    tokens = replies.ndjson_tokens(lines)
    assert replies.segments(tokens, 1000).count() == 20
    content = replies.reassemble(tokens, 1000).first()["content"]
    assert content == "".join(f"{i} " for i in range(20000))


def test_whole_bodies(spark):
    df = spark.createDataFrame(
        [
            ("chat", '{"choices":[{"message":{"content":"a"}}]}'),
            ("generate", '{"response":"b","done":true}'),
            ("generate", "{}"),
        ],
        "style string, body string",
    )
    got = [r[0] for r in df.select(replies.reply_text("style", F.col("body"))).collect()]
    assert got == ["a", "b", None]


FRAMES = [
    ('{"sources": ["a --- b", "c"]}\n---\ntext\n---\nmore', ["a --- b", "c"], "text\n---\nmore"),
    ("no marker --- here", [], "no marker --- here"),
    ('{"sources": []}\n---\n', [], ""),
    ("not json\n---\nx", [], "x"),
    ("", [], ""),
]


def test_frames_are_split_once_on_the_full_marker(spark):
    df = spark.createDataFrame([(f[0],) for f in FRAMES], "raw string")
    got = replies.decode_frame(df).collect()
    assert [(r["sources"], r["content"]) for r in got] == [(f[1], f[2]) for f in FRAMES]


def test_encoded_frames_come_back(spark):
    data = [(['é "q"\n---\n', "b"], "text \\ with\n---\nmark"), ([], "dropped")]
    df = spark.createDataFrame(data, "s array<string>, t string")
    frames = df.select(replies.encode_frame("s", "t").alias("raw"))
    got = replies.decode_frame(frames).collect()
    assert (got[0]["sources"], got[0]["content"]) == data[0]
    assert json.loads(got[0]["raw"].split("\n---\n")[0])["sources"] == data[0][0]
    assert got[1]["raw"] == fixed.NO_STREAM_ANSWER


def test_lines_are_read_from_files(spark, tmp_path):
    row = {"response_id": "a", "seq": 0, "line": '{"response":"x"}'}
    (tmp_path / "log.json").write_text(json.dumps(row) + "\n")
    assert rows(read_lines(spark, str(tmp_path))) == [("a", 0, '{"response":"x"}')]
