"""Jobs over logged runs that call tools.

A turn is one model reply: ``run_id``, one or more order columns, ``content`` and
``tool_calls array<struct<name, args>>`` with the arguments as JSON text. Every
ranked filter below has a literal bound, so Spark trims long runs in the map tasks,
before the shuffle; nothing collects a run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from askloom import fixed
from askloom.functions.jsontext import canonical_json
from askloom.functions.schemas import call_violation
from askloom.functions.text import clip
from askloom.plans import sizing

SALTS = 1024  # slices of one kind of call when repeats are flagged
CATALOGUE_BYTES = 8 << 20  # names and arguments of tools; more are joined by a shuffle

_CALL = "struct<function: struct<name: string, arguments: string>>"
_RAW = f"content string, tool_calls array<{_CALL}>"


def normalize_messages(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse assistant messages: add ``content`` and ``tool_calls`` from their JSON text.

    Arguments may be a JSON object or a string holding one; both arrive as text here.
    Content that is NULL becomes empty. ``unreadable`` marks a raw text that is no JSON
    object: such a reply is no answer, its run failed (``sessions.drop_failed``).
    """
    raw_text = F.trim(F.coalesce(F.col(raw), F.lit("")))
    readable = raw_text.startswith("{") & F.try_parse_json(raw_text).isNotNull()
    parsed = F.from_json(F.col(raw), _RAW)
    calls = F.transform(
        F.coalesce(F.col("__raw.tool_calls"), F.array().cast(f"array<{_CALL}>")),
        lambda c: F.struct(
            c["function"]["name"].alias("name"), c["function"]["arguments"].alias("args")
        ),
    )
    return (
        messages.withColumn("__raw", parsed)
        .withColumn("unreadable", ~readable)
        .withColumn("content", F.coalesce("__raw.content", F.lit("")))
        .withColumn("tool_calls", calls)
        .drop("__raw")
    )


def cap_turns(
    turns: DataFrame, order: list[str], max_steps: int = fixed.MAX_STEPS
) -> DataFrame:
    """Keep the turns a run would have made: the first ``max_steps``, up to an answer.

    Adds ``step`` (1-based) and ``answered_at``, the step of the first turn without
    calls, or NULL if the run reached the cap.
    """
    run = Window.partitionBy("run_id")
    answers = F.when(F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0, F.col("step"))
    return (
        turns.withColumn("step", F.dense_rank().over(run.orderBy(*order)))
        .filter(F.col("step") <= max_steps)
        .withColumn("answered_at", F.min(answers).over(run))
        .filter(F.col("answered_at").isNull() | (F.col("step") <= F.col("answered_at")))
    )


def explode_calls(turns: DataFrame, order: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per call: ``run_id``, order columns, ``pos`` in its turn, name, args, key."""
    calls = turns.select(
        "run_id", *order, *keep, F.posexplode("tool_calls").alias("pos", "call")
    ).select("run_id", *order, *keep, "pos", "call.name", "call.args")
    return with_call_key(calls)


def with_call_key(calls: DataFrame) -> DataFrame:
    """Add ``call_key`` and replace unreadable arguments by an empty object."""
    keyed = canonical_json(calls, "args", "__args")
    empty = F.lit("{}")
    return (
        keyed.withColumn("args", F.when(F.col("__args").isNull(), empty).otherwise(F.col("args")))
        .withColumn("call_key", F.concat("name", F.lit(":"), F.coalesce("__args", empty)))
        .drop("__args")
    )


def with_results(calls: DataFrame, messages: DataFrame, order: str = "seq") -> DataFrame:
    """Add the logged ``result`` of each call; calls without one keep NULL.

    Tool messages follow the turn that called them, one per call and in call order, so
    the message of a call is found by position.
    """
    answers = messages.filter("role = 'tool'").select(
        "run_id", F.col(order).alias("__at"), F.col("content").alias("result")
    )
    placed = calls.withColumn("__at", F.col(order) + 1 + F.col("pos"))
    return placed.join(answers, ["run_id", "__at"], "left").drop("__at")


def first_calls(calls: DataFrame, order: list[str]) -> DataFrame:
    """The first call of each kind in a run. Each map task ships at most one row per kind."""
    kind = Window.partitionBy("run_id", "call_key").orderBy(*order, "pos")
    return (
        calls.withColumn("__rank", F.row_number().over(kind)).filter("__rank = 1").drop("__rank")
    )


def flag_repeats(calls: DataFrame, order: list[str]) -> DataFrame:
    """Add ``repeated`` to every call, in two steps so that no kind of call fills a task.

    Calls of a kind are first ranked within ``SALTS`` slices cut by a hash of their
    position. A call that is not the first of its slice is a repeat. The firsts, at most
    ``SALTS`` per kind, are then ranked against each other; the others stay in slices.
    """
    at = [*order, "pos"]
    kind = ["run_id", "call_key"]
    slices = Window.partitionBy(*kind, "__slice").orderBy(*at)
    heats = Window.partitionBy(*kind, "__heat").orderBy(*at)
    return (
        calls.withColumn("__slice", F.pmod(F.xxhash64(*at), F.lit(SALTS)))
        .withColumn("__rank", F.row_number().over(slices))
        .withColumn("__heat", F.when(F.col("__rank") == 1, F.lit(-1)).otherwise(F.col("__slice")))
        .withColumn("repeated", (F.col("__rank") > 1) | (F.row_number().over(heats) > 1))
        .drop("__slice", "__rank", "__heat")
    )


def step_log(calls: DataFrame, order: list[str]) -> DataFrame:
    """Steps: first calls only, with the result cut to its stored length."""
    return first_calls(calls, order).select(
        "run_id", *order, "pos", F.col("name").alias("tool"), "args", clip("result").alias("result")
    )


def tool_messages(calls: DataFrame, order: list[str], dedup: bool = True) -> DataFrame:
    """One message per call, repeats included, with the full result.

    With ``dedup`` a repeated call carries the fixed text instead of its result.
    """
    content = F.col("result")
    if dedup:
        calls = flag_repeats(calls, order)
        content = F.when(F.col("repeated"), F.lit(fixed.REPEATED_CALL)).otherwise(content)
    return calls.select(
        "run_id",
        *order,
        "pos",
        F.lit("tool").alias("role"),
        content.alias("content"),
        F.col("name").alias("tool_name"),
    )


def final_answers(capped: DataFrame) -> DataFrame:
    """``run_id, answer``: content of the first turn without calls, if within the cap."""
    answer = F.min_by(
        F.coalesce("content", F.lit("")),
        F.when(F.col("step") == F.col("answered_at"), F.col("step")),
    )
    return capped.groupBy("run_id").agg(
        F.coalesce(answer, F.lit(fixed.STEPS_EXHAUSTED)).alias("answer")
    )


def tool_catalogue(spark: SparkSession, tools=None) -> DataFrame:
    return spark.createDataFrame(
        fixed.TOOL_CATALOGUE if tools is None else tools, "name string, required array<string>"
    )


def validate_calls(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add ``reason``: why a call could not have run, or NULL.

    Call names are few and skewed, so a catalogue of checked size is broadcast and the
    calls stay where they are.
    """
    given = F.coalesce(F.json_object_keys("args"), F.array().cast("array<string>"))
    missing = F.array_except("required", given)
    reason = F.when(F.col("required").isNull(), F.lit("unknown tool")).when(
        F.size(missing) > 0, F.concat(F.lit("missing argument: "), F.array_join(missing, ", "))
    )
    known = sizing.broadcast_if_small(catalogue, CATALOGUE_BYTES)
    return calls.join(known, "name", "left").withColumn("reason", reason).drop("required")


def validate_typed(calls: DataFrame, parameters: Mapping[str, Mapping] = fixed.TOOL_PARAMETERS) -> DataFrame:
    """Add ``reason``: why a call could not have run by its tool's declared types, or NULL.

    Every schema is an expression, so calls are judged where they are, without a join.
    """
    reason = F.lit("unknown tool")
    for name, schema in parameters.items():
        reason = F.when(F.col("name") == name, call_violation(F.col("args"), schema)).otherwise(reason)
    return calls.withColumn("reason", reason)


def dispatch(calls: DataFrame, tools: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Add ``result`` by calling the function registered under each call's name.

    A tool maps the arguments column to a result column and may be a pandas function
    or a plain expression; it sees NULL for calls of other tools. One pass over the
    calls; unknown tools give NULL.
    """
    results = []
    for name, tool in tools.items():
        mine = F.col("name") == name
        results.append(F.when(mine, tool(F.when(mine, F.col("args"))).cast("string")))
    result = F.coalesce(*results) if results else F.lit(None).cast("string")
    return calls.withColumn("result", result)
