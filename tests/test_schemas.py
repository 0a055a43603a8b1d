"""Compiled parameter schemas against a plain check of parsed values."""

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from askloom import fixed
from askloom.functions import schemas
from askloom.operators import toolcalls

DEEP = {
    "type": "object",
    "properties": {
        "a": {"type": "integer"},
        "b c": {"type": ["string", "null"], "enum": ["é", None, "x\"y"]},
        "list": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number"}}, "required": ["n"]}},
        "flag": {"type": "boolean"},
        "any": {},
    },
    "required": ["a", "list"],
    "additionalProperties": False,
}


def kind(value):
    if value is None or isinstance(value, bool):
        return "null" if value is None else "boolean"
    return {str: "string", int: "number", float: "number", list: "array", dict: "object"}[type(value)]


def plain_violation(value, schema, at=""):
    label, own = at or "arguments", kind(value)
    wanted = schema.get("type", [])
    wanted = [wanted] if isinstance(wanted, str) else wanted
    if wanted and own not in wanted and not ("integer" in wanted and own == "number" and value == int(value)):
        return f"{label}: {own} instead of {' or '.join(wanted)}"
    if "enum" in schema and not any(kind(v) == own and v == value for v in schema["enum"]):
        return f"{label}: not one of " + ", ".join(json.dumps(v, ensure_ascii=False) for v in schema["enum"])
    names = schema.get("properties", {})
    if own == "object":
        for name in schema.get("required", []):
            if name not in value:
                return f"missing argument: {at}.{name}" if at else f"missing argument: {name}"
        for name in names:
            if name in value and (found := plain_violation(value[name], names[name], f"{at}.{name}" if at else name)):
                return found
        more = sorted(set(value) - set(names))
        if schema.get("additionalProperties") is False and more:
            return f"unknown argument: {at + '.' if at else ''}{more[0]}"
    if own == "array" and "items" in schema:
        return next((f for v in value if (f := plain_violation(v, schema["items"], f"{label}[]"))), None)
    return None


def made(rng, depth=0):
    atoms = [None, True, 1, 2.5, 3.0, -1e20, "é", "x\"y", "", 10**17]
    if depth > 2 or rng.random() < 0.4:
        return rng.choice(atoms)
    if rng.random() < 0.5:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {k: made(rng, depth + 1) for k in rng.sample(["a", "b c", "list", "flag", "any", "n", "z"], rng.randint(0, 5))}


def test_compiled_schema_equals_a_plain_check(spark):
    rng = random.Random(4)
    values = [made(rng) for _ in range(400)]
    for _ in range(600):
        value = {"a": rng.choice([1, 2.0, 2.5, "1"]), "list": [{"n": rng.choice([1, 2.5, "x", None])} for _ in range(rng.randint(0, 3))]}
        value |= rng.choice([{}, {"flag": rng.choice([True, 0])}, {"b c": rng.choice(["é", None, "x\"y", "q", 1])}, {"any": [1]}, {"z": 1, "y": 2}])
        values.append(value)
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "i int, args string")
    got = dict(rows(df.select("i", F.coalesce(schemas.call_violation(F.col("args"), DEEP), F.lit("fine")))))
    want = {i: (plain_violation(v, DEEP) or "fine") if isinstance(v, dict) else schemas.UNREADABLE for i, v in enumerate(values)}
    assert got == want
    assert len(set(want.values())) > 12


@pytest.mark.parametrize("text", [None, "", "nonsense", '{"a":1,"a":2}', "[]", "3", "null", '{"a":1} x', '{"a":1},{}', '{"a":1}] x', '{"a":1}} x', '{"a":1},'])
def test_what_is_no_object_is_unreadable(spark, text):
    df = spark.createDataFrame([(text,)], "args string")
    assert df.select(schemas.call_violation(F.col("args"), {})).first()[0] == schemas.UNREADABLE


def test_declared_tools_and_native_plan(spark):
    calls = [
        ("get_weather", '{"latitude": 1, "longitude": 2.5}', None), ("get_weather", '{"latitude": "1", "longitude": 2}', "latitude: string instead of number"),
        ("get_weather", '{"latitude": 1}', "missing argument: longitude"), ("calculate", '{"expression": 5}', "expression: number instead of string"),
        ("search_knowledge_base", '{"query": "x", "more": 1}', None), ("get_current_time", "{}", None), ("other", "{}", "unknown tool"),
        ("get_current_time", None, schemas.UNREADABLE), (None, "{}", "unknown tool"),
    ]
    df = spark.createDataFrame([(i, n, a) for i, (n, a, _) in enumerate(calls)], "i int, name string, args string")
    checked = toolcalls.validate_typed(df)
    assert [r.reason for r in checked.orderBy("i").collect()] == [r for *_, r in calls]
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan
    assert set(fixed.TOOL_PARAMETERS) == {n for n, _ in fixed.TOOL_CATALOGUE}
    assert all(fixed.TOOL_PARAMETERS[n].get("required", []) == r for n, r in fixed.TOOL_CATALOGUE)
