"""Tool-call jobs with the events table as a log of runs.

A run is a user, a turn is an event, ordered by time. An ``error`` event is a reply
without calls; any other event calls the tool named by its type.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

from askloom import fixed
from askloom.checks.registry import check, table
from askloom.functions import scalars
from askloom.operators import toolcalls

ORDER = ["ts", "event_id"]


def turns(spark, sf_dir):
    call = F.struct(F.col("event_type").alias("name"), F.col("props").alias("args"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        *ORDER,
        F.concat(F.lit("value "), F.col("value").cast("string")).alias("content"),
        F.when(F.col("event_type") != "error", F.array(call)).alias("tool_calls"),
    )


def calls(spark, sf_dir):
    """Calls of the turns a run would have made, with the turn's content as result."""
    capped = toolcalls.cap_turns(turns(spark, sf_dir), ORDER)
    return toolcalls.explode_calls(capped, ORDER, ("content",)).withColumnRenamed("content", "result")


def all_calls(spark, sf_dir):
    """Every event of the log as one call, without a step cap."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        *ORDER,
        F.lit(0).alias("pos"),
        F.col("event_type").alias("name"),
        F.col("props").alias("args"),
        F.col("value").cast("string").alias("result"),
    )
    return toolcalls.with_call_key(events)


CAPPED_SQL = """
WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
first_five AS (
  SELECT *, min(CASE WHEN event_type = 'error' THEN step END) OVER (PARTITION BY user_id) AS answered
  FROM numbered WHERE step <= 5),
capped AS (SELECT * FROM first_five WHERE answered IS NULL OR step <= answered),
calls AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS nth
  FROM capped WHERE event_type <> 'error')
"""


@check(
    """
WITH calls AS (
  SELECT *, unnest(range(CASE WHEN event_type = 'error' THEN 1 ELSE 1 + event_id % 3 END)) AS pos FROM events)
SELECT event_id, pos::BIGINT AS pos, CASE WHEN event_type = 'error' THEN 'value ' || value ELSE '' END AS content,
       CASE WHEN event_type = 'error' THEN NULL WHEN pos = 0 THEN event_type ELSE 'log' || pos END AS name,
       CASE WHEN event_type = 'error' THEN NULL WHEN pos > 0 THEN '{"n":' || pos || '}'
            WHEN user_id % 2 = 0 THEN replace(props, ' ', '') ELSE props END AS args
FROM calls
"""
)
def normalize_messages(spark, sf_dir):
    """Raw assistant messages of both styles, with one to three calls; all of them come out."""
    # An object comes back as compact text, a string as it was written.
    def call(name, args, as_object):
        shown = args if as_object else F.regexp_extract(F.to_json(F.struct(args.alias("a"))), r"^\{\"a\":(.*)\}$", 1)
        return F.concat(F.lit('{"function":{"name":"'), name, F.lit('","arguments":'), shown, F.lit("}}"))

    def raw_calls(as_object):
        more = [
            F.when(F.col("event_id") % 3 >= i, F.concat(F.lit(","), call(F.lit(f"log{i}"), F.lit('{"n":%d}' % i), as_object))).otherwise("")
            for i in (1, 2)
        ]
        first = call(F.col("event_type"), F.col("props"), as_object)
        return F.concat(F.lit('{"content":null,"tool_calls":['), first, *more, F.lit("]}"))

    reply = F.to_json(
        F.struct(F.concat(F.lit("value "), F.col("value").cast("string")).alias("content"))
    )
    raw = (
        F.when(F.col("event_type") == "error", reply)
        .when(F.col("user_id") % 2 == 0, raw_calls(True))
        .otherwise(raw_calls(False))
    )
    messages = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return toolcalls.normalize_messages(messages).select(
        "event_id", "content", F.posexplode_outer("tool_calls").alias("pos", "call")
    ).select("event_id", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), "content", "call.name", "call.args")


@check(
    """
SELECT event_id, event_type || ':{"k":' || json_extract_string(props, '$.k') || ',"value":' || value
       || ',"who":"' || user_id || '"}' AS call_key
FROM events
"""
)
def call_keys(spark, sf_dir):
    """Arguments written in another key order and spacing give the sorted compact key."""
    args = F.concat(
        F.lit('{ "who" : "'),
        F.col("user_id").cast("string"),
        F.lit('" , "value" : '),
        F.col("value").cast("string"),
        F.lit(' , "k" : '),
        F.get_json_object("props", "$.k"),
        F.lit(" }"),
    )
    written = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("name"), args.alias("args")
    )
    return toolcalls.with_call_key(written).select("event_id", "call_key")


@check(
    """
SELECT event_id, user_id AS run_id, event_type || ':' || replace(props, ' ', '') AS call_key,
       row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1 AS repeated
FROM events
"""
)
def toolcall_first(spark, sf_dir):
    """Repeat flags over the whole log."""
    flagged = toolcalls.flag_repeats(all_calls(spark, sf_dir), ORDER)
    return flagged.select("event_id", "run_id", "call_key", "repeated")


@check(
    CAPPED_SQL
    + """
SELECT event_id, user_id AS run_id, event_type AS tool, props AS args, left('value ' || value, 200) AS result
FROM calls WHERE nth = 1
"""
)
def toolcall_steps(spark, sf_dir):
    steps = toolcalls.step_log(calls(spark, sf_dir), ORDER)
    return steps.select("event_id", "run_id", "tool", "args", "result")


@check(
    f"""
SELECT event_id, user_id AS run_id, 'tool' AS role, event_type AS tool_name,
       CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1
            THEN '{fixed.REPEATED_CALL}' ELSE value::VARCHAR END AS content
FROM events
"""
)
def tool_messages(spark, sf_dir):
    """One tool message per call of the whole log, repeats with the fixed text."""
    messages = toolcalls.tool_messages(all_calls(spark, sf_dir), ORDER)
    return messages.select("event_id", "run_id", "role", "tool_name", "content")


@check(
    CAPPED_SQL
    + """
SELECT event_id, user_id AS run_id, 'tool' AS role, event_type AS tool_name, 'value ' || value AS content
FROM calls
"""
)
def tool_messages_plain(spark, sf_dir):
    """Capped runs of the variant that does not check for repeats."""
    messages = toolcalls.tool_messages(calls(spark, sf_dir), ORDER, dedup=False)
    return messages.select("event_id", "run_id", "role", "tool_name", "content")


@check(
    CAPPED_SQL
    + f"""
SELECT user_id AS run_id,
       coalesce(max(CASE WHEN step = answered THEN 'value ' || value END), '{fixed.STEPS_EXHAUSTED}') AS answer
FROM capped GROUP BY user_id
"""
)
def run_answer(spark, sf_dir):
    return toolcalls.final_answers(toolcalls.cap_turns(turns(spark, sf_dir), ORDER))


@check(
    """
SELECT event_id, user_id AS run_id, pos, CASE WHEN pos = 0 THEN event_type ELSE 'log' END AS name,
       CASE WHEN pos = 0 THEN 'value ' || value ELSE 'logged ' || event_id END AS result
FROM events, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS pos) WHERE event_type <> 'error'
"""
)
def logged_results(spark, sf_dir):
    """A full message log: turns with two calls each, followed by their tool messages."""
    first = F.struct(F.col("event_type").alias("name"), F.col("props").alias("args"))
    second = F.struct(F.lit("log").alias("name"), F.lit("{}").alias("args"))
    made = F.when(F.col("event_type") != "error", F.array(first, second))
    value = F.concat(F.lit("value "), F.col("value").cast("string"))

    def row(offset, role, content, tool_calls):
        return F.struct(
            (F.col("event_id") * 3 + offset).alias("seq"),
            F.lit(role).alias("role"),
            content.alias("content"),
            tool_calls.alias("tool_calls"),
        )

    no_calls = F.lit(None).cast("array<struct<name: string, args: string>>")
    turn = row(0, "assistant", F.lit(""), made)
    answers = [
        row(1, "tool", value, no_calls),
        row(2, "tool", F.concat(F.lit("logged "), F.col("event_id").cast("string")), no_calls),
    ]
    rows = F.when(F.col("event_type") == "error", F.array(turn)).otherwise(F.array(turn, *answers))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.inline(rows))
    turns_only = log.filter("role = 'assistant'")
    answered = toolcalls.with_results(toolcalls.explode_calls(turns_only, ["seq"]), log)
    return answered.select(
        (F.col("seq") / 3).cast("long").alias("event_id"),
        "run_id",
        F.col("pos").cast("long").alias("pos"),
        "name",
        "result",
    )


CATALOGUE = [("view", ["k"]), ("click", ["k", "target"]), ("purchase", [])]


@check(
    """
SELECT event_id, event_type AS name,
       CASE WHEN event_type IN ('signup', 'error') THEN 'unknown tool'
            WHEN event_type = 'click' THEN 'missing argument: target' END AS reason
FROM events
"""
)
def tool_validation(spark, sf_dir):
    catalogue = toolcalls.tool_catalogue(spark, CATALOGUE)
    checked = toolcalls.validate_calls(all_calls(spark, sf_dir), catalogue)
    return checked.select("event_id", "name", "reason")


PLACE = {
    "type": "object",
    "properties": {"unit": {"enum": ["m", "km"]}, "at": {"type": "array", "items": {"type": ["number", "null"]}}},
    "required": ["unit"],
    "additionalProperties": False,
}
TYPED_TOOLS = fixed.TOOL_PARAMETERS | {
    "purchase": {"type": "object", "properties": {"n": {"type": "integer"}, "place": PLACE}, "required": ["n"]},
}


def typed_calls(spark, sf_dir):
    """Every event as a call of a declared tool, with arguments of right and wrong types."""
    event, number = F.col("event_id"), F.col("value").cast("string")
    text = F.concat(F.lit('"'), number, F.lit('"'))
    place = F.concat(
        F.lit('{"unit":"'), F.when(event % 5 == 0, "mile").otherwise("km"), F.lit('","at":[1,null'),
        F.when(event % 7 == 0, ',"x"').otherwise(""), F.lit("]"), F.when(event % 11 == 0, ',"more":0').otherwise(""), F.lit("}"),
    )
    args = (
        F.when(event % 13 == 0, "[1]")
        .when(
            F.col("event_type") == "view",
            F.concat(F.lit('{"latitude":'), F.when(event % 3 == 0, text).otherwise(number), F.when(event % 4 == 0, "").otherwise(',"longitude":1e1'), F.lit("}")),
        )
        .when(F.col("event_type") == "click", F.concat(F.lit('{"query":'), F.when(event % 3 == 0, "null").otherwise(text), F.lit("}")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"n":'), F.when(event % 3 == 0, "2.5").otherwise("2.0"), F.lit(',"place":'), place, F.lit("}")))
        .otherwise("{}")
    )
    names = {"view": "get_weather", "click": "search_knowledge_base", "purchase": "purchase", "signup": "get_current_time"}
    name = F.lit("none")
    for kind, tool in names.items():
        name = F.when(F.col("event_type") == kind, tool).otherwise(name)
    return table(spark, sf_dir, "events").select("event_id", name.alias("name"), args.alias("args"))


@check(
    """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN 'unknown tool'
            WHEN event_id % 13 = 0 THEN 'arguments are not a JSON object'
            WHEN event_type = 'view' THEN CASE
              WHEN event_id % 4 = 0 THEN 'missing argument: longitude'
              WHEN event_id % 3 = 0 THEN 'latitude: string instead of number' END
            WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'query: null instead of string'
            WHEN event_type = 'purchase' THEN CASE
              WHEN event_id % 3 = 0 THEN 'n: number instead of integer'
              WHEN event_id % 5 = 0 THEN 'place.unit: not one of "m", "km"'
              WHEN event_id % 7 = 0 THEN 'place.at[]: string instead of number or null'
              WHEN event_id % 11 = 0 THEN 'unknown argument: place.more' END
       END AS reason
FROM events
"""
)
def tool_types(spark, sf_dir):
    """The declared types of all tools, and one with nested parameters."""
    return toolcalls.validate_typed(typed_calls(spark, sf_dir), TYPED_TOOLS).select("event_id", "reason")


def _doubled(args: pd.Series) -> pd.Series:
    numbers = args.str.extract(r'"k":\s*(\d+)', expand=False).astype("Int64")
    return (numbers * 2).astype("string").astype(object).where(numbers.notna(), None)


@check(
    """
SELECT event_id, event_type AS name,
       CASE event_type WHEN 'view' THEN json_extract_string(props, '$.k')
            WHEN 'click' THEN (2 * json_extract_string(props, '$.k')::BIGINT)::VARCHAR
            WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS result
FROM events
"""
)
def tool_dispatch(spark, sf_dir):
    """Registered tools, native and pandas, on the calls that name them."""
    tools = {
        "view": lambda args: F.get_json_object(args, "$.k"),
        "click": F.pandas_udf(_doubled, T.StringType()),
        "purchase": lambda args: F.when(args.isNotNull(), scalars.format_time("ts")),
    }
    done = toolcalls.dispatch(all_calls(spark, sf_dir).drop("result"), tools)
    return done.select("event_id", "name", "result")
