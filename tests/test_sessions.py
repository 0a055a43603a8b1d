import json

from conftest import rows
from pyspark.sql import functions as F

from askloom import fixed
from askloom.checks import CHECKS
from askloom.operators import sessions
from askloom.plans.ordered import bucket_sizes, number_rows

MESSAGES = "session_id string, turn long, role string, content string"


def replay(log):
    """Session map as a service keeps it: each run prepends a system message."""
    memory = {}
    for session in sorted({m[0] for m in log}):
        turns = sorted(m for m in log if m[0] == session)
        stored, run = [], []
        for _, _, role, content in turns:
            if role == "user" and run:
                stored, run = [("system", fixed.SYSTEM_TEXT)] + stored + run, []
            run.append((role, content))
        memory[session] = [("system", fixed.SYSTEM_TEXT)] + stored + run
    return memory


LOG = [
    (s, t, "user" if t % 3 == 0 else "assistant", f"{s}{t}")
    for s, n in [("a", 1), ("b", 7), ("c", 50)]
    for t in range(n)
]


def test_memory_equals_a_replay_for_any_bucket_size(spark):
    df = spark.createDataFrame(LOG, MESSAGES).repartition(4)
    for sizes in [(), (1,), (7,), (65536,), (2, 6), (3, 6, 24)]:
        stored = sessions.session_memory(df, sizes=sizes)
        got = {}
        for r in stored.orderBy("session_id", "position").collect():
            got.setdefault(r["session_id"], []).append((r["role"], r["content"]))
        assert got == replay(LOG)


def test_earlier_lists_are_the_rows_of_earlier_runs(spark):
    df = spark.createDataFrame(LOG, MESSAGES)
    stored = sessions.session_memory(df).filter("session_id = 'b' AND run_no <= 2")
    got = [(r["role"], r["content"]) for r in stored.orderBy("position").collect()]
    assert got == replay([m for m in LOG if m[0] == "b" and m[1] < 6])["b"]


def test_requests_see_their_history_in_order(spark):
    memory = sessions.session_memory(spark.createDataFrame(LOG, MESSAGES))
    requests = spark.createDataFrame([(1, "b", "next?"), (2, "new", "hello?"), (3, "b", "and?")], "request_id int, session_id string, question string")
    sent = sessions.request_messages(requests, memory).orderBy("request_id", "part", "position").collect()
    system = ("system", fixed.SYSTEM_TEXT)
    assert [(r["role"], r["content"]) for r in sent if r["session_id"] == "new"] == [
        system,
        ("user", "hello?"),
    ]
    assert [(r["role"], r["content"]) for r in sent if r["request_id"] == 1] == (
        [system] + replay(LOG)["b"] + [("user", "next?")]
    )
    assert [(r["role"], r["content"]) for r in sent if r["request_id"] == 3] == (
        [system] + replay(LOG)["b"] + [("user", "and?")]
    )


def test_memory_keeps_null_sessions_and_tool_fields(spark):
    data = [(None, 5_000_000, "user", "q", None, None), (None, 9_000_000, "assistant", "a", "calculate", "[1]")]
    df = spark.createDataFrame(data, MESSAGES + ", tool_name string, tool_calls string")
    stored = sessions.session_memory(df).orderBy("position").collect()
    assert [(r["role"], r["tool_name"], r["tool_calls"]) for r in stored] == [
        ("system", None, None),
        ("user", None, None),
        ("assistant", "calculate", "[1]"),
    ]


def test_failed_runs_store_nothing(spark):
    messages = spark.createDataFrame([(1, "x"), (2, "y")], "run_id int, content string")
    failed = spark.createDataFrame([(2,), (2,)], "run_id int")
    assert rows(sessions.drop_failed(messages, failed)) == [(1, "x")]
    runs = spark.createDataFrame([(1, 1001), (2, 1), (None, 1)], "session_id int, run_no int")
    failed = runs.filter("session_id = 2 OR session_id IS NULL")
    assert rows(sessions.drop_failed(runs, failed, ("session_id", "run_no"))) == [(1, 1001)]


def test_sparse_orders_still_make_buckets_of_many_rows(spark):
    df = spark.range(200_000).select(F.lit("s").alias("k"), (F.col("id") * 1_000_000).alias("o"))
    (width,) = bucket_sizes(df, "o", 10_000)
    per_bucket = df.groupBy(F.floor(F.col("o") / width)).count()
    assert per_bucket.agg(F.max("count")).first()[0] <= 10_001 and per_bucket.count() <= 21


def test_numbering_handles_negative_and_sparse_orders(spark):
    data = [("k", o, o % 2 == 0) for o in [-9, -8, -1, 0, 3, 4096, 10**12]]
    df = spark.createDataFrame(data, "k string, o long, s boolean")
    got = number_rows(df, ["k"], "o", F.col("s"), (4, 16)).orderBy("o").collect()
    assert [(r["row_no"], r["start_no"], r["n_starts"]) for r in got] == [
        (1, 0, 4),
        (2, 1, 4),
        (3, 1, 4),
        (4, 2, 4),
        (5, 2, 4),
        (6, 3, 4),
        (7, 4, 4),
    ]


def test_message_list_of_a_row(spark):
    df = spark.createDataFrame(
        [("q", [("user", "before")]), ("p", None)],
        "question string, history array<struct<role: string, content: string>>",
    )
    got = df.select(sessions.message_list(F.col("question"), F.col("history"))).collect()
    assert [m["content"] for m in got[0][0]] == [fixed.SYSTEM_TEXT, "before", "q"]
    assert [m["role"] for m in got[1][0]] == ["system", "user"]
    assert len(df.select(sessions.message_list(F.col("question"))).first()[0]) == 2


def test_payload_pieces_are_bounded_and_make_one_body(spark):
    memory = spark.createDataFrame(
        [("s", i, "user" if i % 2 else "assistant", f'say "{i}"\n') for i in range(50)], "session_id string, position long, role string, content string"
    )
    requests = spark.createDataFrame([(1, "s", "and?", "m"), (2, "t", "hm", None)], "request_id int, session_id string, question string, model string")
    sent = sessions.request_messages(requests, memory)
    tools = F.array(F.struct(F.lit("function").alias("type")))
    pieces = sessions.payload_segments(sent, requests.withColumn("stream", F.lit(True)), tools, 8).orderBy("segment").collect()
    bodies = {i: json.loads("".join(p["text"] for p in pieces if p["request_id"] == i)) for i in (1, 2)}
    listed = [("system", fixed.SYSTEM_TEXT), *((r["role"], r["content"]) for r in memory.collect()), ("user", "and?")]
    assert [(m["role"], m["content"]) for m in bodies[1]["messages"]] == listed
    assert max(p["text"].count('"role"') for p in pieces) == 8
    assert bodies[1]["model"] == "m" and "model" not in bodies[2] and bodies[2]["stream"] is True
    assert [m["role"] for m in bodies[2]["messages"]] == ["system", "user"] and bodies[2]["tools"] == [{"type": "function"}]


def test_every_question_of_a_session_is_asked_again(spark, tmp_path):
    """Three questions a session make three requests, in the message list and in the bodies."""
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(3) for t in range(6)]
    log = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    log.write.parquet(str(tmp_path / "conversations.parquet"))
    asked = {f"{c}-{t}" for c in range(3) for t in (0, 2, 4)}
    sent = CHECKS["session_requests"].run(spark, str(tmp_path)).collect()
    assert {r.request_id for r in sent} == asked and len(sent) == len(asked) * (2 + 6 + 3)
    bodies = CHECKS["agent_payloads"].run(spark, str(tmp_path)).collect()
    whole = {}
    for r in sorted(bodies, key=lambda r: (r.request_id, r.segment)):
        whole[r.request_id] = whole.get(r.request_id, "") + r.text
    assert set(whole) == asked
    for name, body in whole.items():
        held = json.loads(body)["messages"]
        assert len(held) == 11 and held[-1]["content"] == "text " + name.replace("-", " ")


def test_a_question_logged_twice_is_asked_once(spark, tmp_path):
    turns = [(1, 0, "user", "first"), (1, 0, "user", "first"), (1, 1, "assistant", "answer"), (1, 2, "user", "last")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    sent = CHECKS["session_requests"].run(spark, str(tmp_path)).filter("part = 2").select("request_id")
    assert rows(sent) == [("1-0",), ("1-2",)]
