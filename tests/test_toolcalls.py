import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from askloom import fixed
from askloom.functions.jsontext import canonical_json
from askloom.operators import toolcalls

ARGS = [
    '{"b":1,"a":2}',
    '{"a":2, "b":1}',
    '{"x":1}',
    '{"x":1.0}',
    '{"x":1e0}',
    '{"x":-0}',
    '{"x":01}',
    '{ }',
    '{"a":1,"a":2}',
    '{"a":1} junk',
    '{"a":1}}',
    '{"a":1,}',
    '{"a":true,"c":null,"b":false}',
    '{"a":"é","A":"x y"}',
    '{"a":"\\u00e9","A":"x y"}',
    '{"a":{"z":1,"y":[1,2]}}',
    '{"n":123456789012345678,"m":12345678901234567890}',
    '{"a":NaN}',
    "{'a':1}",
    '{"a":"q\\"q"}',
    '{"a":"tab\t"}',
    '{"a":"\\ud800"}',
    "[1,2]",
    '"text"',
    "",
    "oops",
    ' {"a" : 1 } ',
    '{"a":\x0b1}',
    '{"Z":1,"a":"/","_":"<&>"}',
    "[" * 100000,
]


def expected(text):
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    printed = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return printed.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def test_canonical_json_equals_the_library(spark):
    df = spark.createDataFrame(list(enumerate(ARGS)), "i int, args string")
    got = dict(rows(canonical_json(df, "args", "out").select("i", "out")))
    assert got == {i: expected(a) for i, a in enumerate(ARGS)}


def test_canonical_json_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "args string")
    assert rows(canonical_json(df, "args", "out")) == [(None, None)]


def calls(spark, data):
    return toolcalls.with_call_key(
        spark.createDataFrame(
            data, "run_id string, seq long, pos int, name string, args string, result string"
        )
    )


def test_repeats_are_counted_per_run_and_in_order(spark):
    df = calls(
        spark,
        [
            ("r", 1, 0, "f", '{"a":1,"b":2}', "one"),
            ("r", 1, 1, "f", '{"b":2,"a":1}', "one"),
            ("r", 2, 0, "g", '{"a":1,"b":2}', "two"),
            ("r", 3, 0, "f", '{"a":1,"b":2}', "one"),
            ("s", 1, 0, "f", '{"a":1,"b":2}', "one"),
        ],
    )
    flagged = toolcalls.flag_repeats(df, ["seq"]).select("run_id", "seq", "pos", "repeated")
    assert rows(flagged) == [
        ("r", 1, 0, False),
        ("r", 1, 1, True),
        ("r", 2, 0, False),
        ("r", 3, 0, True),
        ("s", 1, 0, False),
    ]
    contents = toolcalls.tool_messages(df, ["seq"]).select("run_id", "seq", "pos", "content")
    assert [r[3] for r in rows(contents)] == [
        "one",
        fixed.REPEATED_CALL,
        "two",
        fixed.REPEATED_CALL,
        "one",
    ]
    plain = toolcalls.tool_messages(df, ["seq"], dedup=False).select("content")
    assert [r[0] for r in rows(plain)] == ["one", "one", "one", "one", "two"]


def test_steps_keep_first_calls_with_a_cut_result(spark):
    df = calls(
        spark, [("r", 1, 0, "f", "{}", "x" * 300), ("r", 2, 0, "f", " { } ", "y"), ("r", 2, 1, "f", "no", "z")]
    )
    steps = toolcalls.step_log(df, ["seq"]).select("seq", "pos", "tool", "args", "result")
    assert rows(steps) == [(1, 0, "f", "{}", "x" * 200)]


def turns(spark, data):
    return spark.createDataFrame(
        data, "run_id string, seq long, content string, tool_calls array<struct<name string, args string>>"
    )


CALL = [("f", "{}")]


def test_answer_is_the_first_turn_without_calls_within_the_cap(spark):
    data = (
        [("late", i, None, CALL) for i in range(5)]
        + [("late", 5, "too late", [])]
        + [("fifth", i, None, CALL) for i in range(4)]
        + [("fifth", 4, "just in time", None)]
        + [("twice", 0, "first", []), ("twice", 1, "second", [])]
        + [("empty", 0, None, [])]
    )
    capped = toolcalls.cap_turns(turns(spark, data), ["seq"])
    assert rows(toolcalls.final_answers(capped)) == [
        ("empty", ""),
        ("fifth", "just in time"),
        ("late", fixed.STEPS_EXHAUSTED),
        ("twice", "first"),
    ]
    assert capped.filter("run_id = 'twice'").count() == 1


def test_several_calls_in_a_turn_are_one_step(spark):
    data = [("r", i, None, CALL * 3) for i in range(4)] + [("r", 9, "done", [])]
    capped = toolcalls.cap_turns(turns(spark, data), ["seq"])
    assert rows(toolcalls.final_answers(capped)) == [("r", "done")]
    exploded = toolcalls.explode_calls(capped, ["seq"], ("step",))
    assert exploded.count() == 12
    assert exploded.filter("step > 4").count() == 0


def test_messages_of_both_styles(spark):
    raw = [
        (1, '{"content":null,"tool_calls":[{"function":{"name":"f","arguments":"{\\"a\\":1.0}"}}]}'),
        (2, '{"content":"x","tool_calls":[{"function":{"name":"f","arguments":{"a":1.0}}}]}'),
        (3, '{"content":"x","tool_calls":[{"function":{"name":"f","arguments":"oops"}}]}'),
        (4, '{"content":"hi","tool_calls":null}'),
    ]
    df = spark.createDataFrame(raw, "seq long, raw string").withColumn("run_id", F.lit("r"))
    parsed = toolcalls.normalize_messages(df)
    assert [r[0] for r in parsed.orderBy("seq").select("content").collect()] == ["", "x", "x", "hi"]
    keyed = toolcalls.explode_calls(parsed, ["seq"])
    assert rows(keyed.select("seq", "args", "call_key")) == [
        (1, '{"a":1.0}', 'f:{"a":1.0}'),
        (2, '{"a":1.0}', 'f:{"a":1.0}'),
        (3, "{}", "f:{}"),
    ]


def test_validation_names_the_reason(spark):
    df = calls(
        spark,
        [
            ("r", 1, 0, "calculate", '{"expression":"1"}', None),
            ("r", 2, 0, "get_weather", '{"longitude":1}', None),
            ("r", 3, 0, "nosuch", "{}", None),
            ("r", 4, 0, "get_current_time", "{}", None),
        ],
    )
    checked = toolcalls.validate_calls(df, toolcalls.tool_catalogue(spark))
    assert rows(checked.select("seq", "reason")) == [
        (1, None),
        (2, "missing argument: latitude"),
        (3, "unknown tool"),
        (4, None),
    ]


def test_dispatch_without_tools_gives_null(spark):
    df = calls(spark, [("r", 1, 0, "f", "{}", None)]).drop("result")
    assert rows(toolcalls.dispatch(df, {}).select("result")) == [(None,)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_runs_are_trimmed_before_the_shuffle(spark):
    df = turns(spark, [("r", 1, None, CALL)])
    assert plan_of(toolcalls.cap_turns(df, ["seq"])).count("WindowGroupLimit") == 2
    keyed = toolcalls.explode_calls(df, ["seq"])
    assert plan_of(toolcalls.first_calls(keyed, ["seq"])).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("salts", [1, 3, 1024])
def test_flags_do_not_depend_on_the_slices(spark, monkeypatch, salts):
    monkeypatch.setattr(toolcalls, "SALTS", salts)
    data = [("r", i, 0, "f", "{}", "x") for i in range(3000)]
    data += [(f"s{i % 7}", i, i % 2, "g", f'{{"k":{i % 11}}}', "x") for i in range(400)]
    flagged = toolcalls.flag_repeats(calls(spark, data), ["seq"])
    seen, want = set(), []
    for run, seq, pos, name, args, _ in sorted(data, key=lambda c: (c[0], c[1], c[2])):
        want.append((run, seq, pos, (run, name, args) in seen))
        seen.add((run, name, args))
    assert rows(flagged.select("run_id", "seq", "pos", "repeated")) == sorted(want)
    assert "Join" not in plan_of(flagged)
