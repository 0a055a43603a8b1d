"""Requests and session memory with the conversations table as the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom import fixed
from askloom.checks.registry import check, table
from askloom.functions import scalars
from askloom.operators import sessions
from askloom.plans import scratch
from askloom.streaming import jobs


def messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")
    )


def with_tools(log):
    """Some answers carry the raw calls that led to them, some a tool's name."""
    answers = F.col("role") == "assistant"
    calls = F.concat(F.lit('[{"turn": '), F.col("turn").cast("string"), F.lit("}]"))
    return log.withColumns(
        {
            "tool_name": F.when(answers & (F.col("turn") % 3 == 0), F.lit("calculate")),
            "tool_calls": F.when(answers & (F.col("turn") % 2 == 1), calls),
        }
    )


TOOLS_SQL = """
CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'calculate' END AS tool_name,
CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN '[{"turn": ' || turn || '}]' END AS tool_calls
"""

MEMORY_SQL = f"""
WITH numbered AS (
  SELECT conv_id AS session_id, role, text AS content, {TOOLS_SQL},
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_no,
         sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run_no,
         sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS n_runs
  FROM conversations),
memory AS (
  SELECT session_id, (n_runs + row_no - 1)::BIGINT AS position, run_no::BIGINT AS run_no, role, content,
         tool_name, tool_calls
  FROM numbered
  UNION ALL
  SELECT session_id, (run_no - 1)::BIGINT, run_no::BIGINT, 'system', '{fixed.SYSTEM_TEXT}', NULL, NULL
  FROM numbered WHERE role = 'user')
"""


@check(MEMORY_SQL + "SELECT session_id, position, run_no, role, content, tool_name, tool_calls FROM memory")
def session_memory(spark, sf_dir):
    return sessions.session_memory(with_tools(messages(spark, sf_dir)))


@check(
    MEMORY_SQL
    + f"""
, requests AS (
  SELECT conv_id AS session_id, arg_max(text, turn) AS question FROM conversations
  WHERE role = 'user' GROUP BY conv_id)
SELECT session_id AS request_id, session_id, 1 AS part, position, role, content, tool_name, tool_calls FROM memory
WHERE session_id IN (SELECT session_id FROM requests)
UNION ALL SELECT session_id, session_id, 0, 0, 'system', '{fixed.SYSTEM_TEXT}', NULL, NULL FROM requests
UNION ALL SELECT session_id, session_id, 2, 0, 'user', question, NULL, NULL FROM requests
"""
)
def session_lookup(spark, sf_dir):
    """Messages of a new request per session: system text, stored memory, question."""
    log = with_tools(messages(spark, sf_dir))
    requests = (
        log.filter("role = 'user'")
        .groupBy("session_id")
        .agg(F.max_by("content", "turn").alias("question"))
        .withColumn("request_id", F.col("session_id"))
    )
    return sessions.request_messages(requests, stored_memory(spark, log))


def stored_memory(spark, log):
    path = scratch.new_path(spark, "memory")
    sessions.session_memory(log).write.parquet(path)
    return spark.read.parquet(path)


def open_requests(log):
    """Every user message asked again, so that most sessions have several requests; one that is
    logged twice is asked once."""
    return log.filter("role = 'user'").dropDuplicates(["session_id", "turn", "content"]).select(
        F.concat_ws("-", F.col("session_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        "session_id",
        F.col("content").alias("question"),
    )


REQUESTS_SQL = MEMORY_SQL + f"""
, requests AS (
  SELECT conv_id || '-' || turn AS request_id, conv_id AS session_id, text AS question FROM conversations
  WHERE role = 'user'),
sent AS (
  SELECT request_id, session_id, 1 AS part, position, role, content FROM memory JOIN requests USING (session_id)
  UNION ALL SELECT request_id, session_id, 0, 0, 'system', '{fixed.SYSTEM_TEXT}' FROM requests
  UNION ALL SELECT request_id, session_id, 2, 0, 'user', question FROM requests)
"""


@check(REQUESTS_SQL + "SELECT * FROM sent")
def session_requests(spark, sf_dir):
    """Several open requests per session, told apart by their id."""
    log = messages(spark, sf_dir)
    return sessions.request_messages(open_requests(log), stored_memory(spark, log))


PAYLOAD_ROWS = 4


@check(
    REQUESTS_SQL
    + f"""
, models AS (
  SELECT *, CASE WHEN session_id % 2 = 0 THEN '{fixed.CHAT_AGENT_MODEL}' ELSE '{fixed.AGENT_MODEL}' END AS model FROM requests)
SELECT request_id, session_id, 0::BIGINT AS segment, '{{"model":"' || model || '","messages":[' AS text FROM models
UNION ALL
SELECT request_id, session_id, part * 1099511627776 + position // {PAYLOAD_ROWS} + 1,
       CASE WHEN part = 0 THEN '' ELSE ',' END
       || string_agg(to_json({{'role': role, 'content': content}})::VARCHAR, ',' ORDER BY position)
FROM sent GROUP BY request_id, session_id, part, position // {PAYLOAD_ROWS}
UNION ALL
SELECT request_id, session_id, 1152921504606846976,
       '],"tools":[{{"type":"function"}}],"tool_choice":"auto","stream":false}}' FROM models
"""
)
def agent_payloads(spark, sf_dir):
    """Bodies of agent requests in bounded pieces; the model left out follows the backend's style."""
    log = messages(spark, sf_dir)
    requests = open_requests(log)
    style = F.when(F.col("session_id") % 2 == 0, "chat").otherwise("generate")
    filled = scalars.agent_requests(requests.withColumn("model", F.lit(None).cast("string")), style)
    filled = filled.select("request_id", "session_id", "model", F.lit(False).alias("stream"))
    tools = F.array(F.struct(F.lit("function").alias("type")))
    return sessions.payload_segments(
        sessions.request_messages(requests, stored_memory(spark, log)), filled, tools, PAYLOAD_ROWS
    )


@check(
    """
SELECT conv_id AS session_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS n_runs,
       count(*) AS n_messages
FROM conversations GROUP BY conv_id
"""
)
def session_totals(spark, sf_dir):
    return jobs.session_totals(messages(spark, sf_dir))


@check(
    """
WITH runs AS (
  SELECT conv_id, turn, role, text,
         sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn) AS run_no
  FROM conversations)
SELECT conv_id AS session_id, turn, role, text AS content FROM runs
WHERE (conv_id, run_no) NOT IN (SELECT (conv_id, run_no) FROM runs WHERE role = 'user' AND length(text) % 3 = 0)
"""
)
def failed_runs_dropped(spark, sf_dir):
    """Runs with a question of certain lengths count as failed and store nothing."""
    runs = sessions.number_rows(
        messages(spark, sf_dir), ["session_id"], "turn", F.col("role") == "user"
    ).withColumnRenamed("start_no", "run_no")
    path = scratch.new_path(spark, "runs")
    runs.write.parquet(path)
    numbered = spark.read.parquet(path)
    failed = numbered.filter((F.col("role") == "user") & (F.length("content") % 3 == 0))
    stored = sessions.drop_failed(numbered, failed, ("session_id", "run_no"))
    return stored.select("session_id", "turn", "role", "content")


@check(
    f"""
SELECT conv_id, turn, 0::BIGINT AS pos, 'system' AS role, '{fixed.SYSTEM_TEXT}' AS content FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'assistant', 're: ' || text FROM conversations WHERE turn % 2 = 0
UNION ALL SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END, 'user', text FROM conversations
"""
)
def message_list(spark, sf_dir):
    """Message list of a row with and without its own history array."""
    past = F.array(sessions.message("assistant", F.concat(F.lit("re: "), F.col("text"))))
    history = F.when(F.col("turn") % 2 == 0, past)
    listed = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.posexplode(sessions.message_list(F.col("text"), history)).alias("pos", "m"),
    )
    return listed.select(
        "conv_id", "turn", F.col("pos").cast("long").alias("pos"), "m.role", "m.content"
    )


BLANK = "\xa0\t\n"


@check(
    f"""
SELECT conv_id, turn, trim(text, '{fixed.WHITESPACE}') AS question,
       CASE WHEN turn % 2 = 0 THEN 'session ' || conv_id ELSE '{fixed.DEFAULT_SESSION}' END AS session_id,
       CASE WHEN turn % 3 = 0 THEN 'm' ELSE '{fixed.AGENT_MODEL}' END AS model,
       (CASE WHEN turn % 4 = 0 THEN 7 ELSE {fixed.TOP_K} END)::BIGINT AS "limit",
       CASE WHEN turn % 3 = 0 THEN 'm' ELSE '{fixed.GENERATE_MODEL}' END AS chat_model
FROM conversations WHERE role <> 'assistant' AND length(trim(text, '{fixed.WHITESPACE}')) > 0
"""
)
def request_defaults(spark, sf_dir):
    """Fields left out get their defaults; blank questions (here: of assistants) go."""
    padded = F.concat(F.lit(BLANK), F.col("text"), F.lit(BLANK))
    requests = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "assistant", F.lit(BLANK)).otherwise(padded).alias("question"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("session "), F.col("conv_id").cast("string"))).alias(
            "session_id"
        ),
        F.when(F.col("turn") % 3 == 0, F.lit("m")).alias("model"),
        F.when(F.col("turn") % 4 == 0, F.lit(7).cast("long")).alias("limit"),
        F.when(F.col("turn") % 3 == 0, F.lit("m")).otherwise(F.lit("")).alias("chat_model"),
    )
    filled = scalars.agent_requests(scalars.search_requests(scalars.asked_questions(requests)))
    return filled.withColumn("chat_model", scalars.or_model("chat_model"))


@check(
    f"""
SELECT conv_id, turn,
       CASE WHEN turn % 2 = 0
         THEN to_json({{'model': '{fixed.GENERATE_MODEL}',
                        'messages': [{{'role': 'user', 'content': text}}],
                        'stream': role = 'user'}})::VARCHAR
         ELSE to_json({{'model': '{fixed.GENERATE_MODEL}', 'prompt': text, 'stream': role = 'user'}})::VARCHAR
       END AS payload
FROM conversations
"""
)
def request_payloads(spark, sf_dir):
    style = F.when(F.col("turn") % 2 == 0, "chat").otherwise("generate")
    payload = scalars.request_payload(style, F.lit(""), "text", F.col("role") == "user")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", payload.alias("payload")
    )
