"""Message lists of runs and the memory that sessions keep between runs.

Lists are tables in long form, one row per message with its position. A session may
then grow without limit; no row or task ever holds it whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from askloom import fixed
from askloom.plans.ordered import number_rows
from askloom.plans.skew import spread_join

SYSTEM, HISTORY, QUESTION = 0, 1, 2
SEGMENT_MESSAGES = 1024


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def message_list(question: Column, history: Column | None = None) -> Column:
    """Messages of one run that carries its own history array."""
    kind = "array<struct<role: string, content: string>>"
    past = F.array() if history is None else F.coalesce(history, F.array().cast(kind))
    return F.concat(
        F.array(message("system", F.lit(fixed.SYSTEM_TEXT))),
        past.cast(kind),
        F.array(message("user", question)),
    )


def request_messages(requests: DataFrame, memory: DataFrame) -> DataFrame:
    """Messages sent for each request: system text, session history, question.

    ``requests`` holds open requests, any number per ``session_id``, told apart by
    ``request_id``; ``memory`` is the output of ``session_memory``, read from where it is
    stored. The messages of a request are its rows ordered by ``part, position``; further
    columns of the memory, such as tool fields, are NULL outside the history.
    """
    facts = [c for c in memory.columns if c not in ("session_id", "run_no")]
    past = spread_join(memory.select("session_id", *facts), requests.select("request_id", "session_id"), "session_id")
    past = past.select("request_id", "session_id", F.lit(HISTORY).alias("part"), *facts)
    own = requests.select(
        "request_id",
        "session_id",
        F.inline(
            F.array(
                _part(SYSTEM, "system", F.lit(fixed.SYSTEM_TEXT)),
                _part(QUESTION, "user", F.col("question")),
            )
        ),
    )
    return past.unionByName(own, allowMissingColumns=True)


def payload_segments(
    sent: DataFrame, requests: DataFrame, tools: Column, rows: int = SEGMENT_MESSAGES
) -> DataFrame:
    """``request_id, session_id, segment, text``: the body an agent request sends, in pieces.

    The texts of a request, by ``segment``, are its JSON body end to end. A piece holds at
    most ``rows`` messages, so a request on a session of any length is never one row.
    ``sent`` is the stored output of ``request_messages``; ``requests`` gives ``model`` and
    ``stream``; ``tools`` are the tool descriptions, the same for all. NULL fields are left out.
    """
    facts = [c for c in sent.columns if c not in ("request_id", "session_id", "part", "position")]
    at = F.col("part").cast("long") * F.lit(1 << 40) + F.floor(F.col("position") / F.lit(rows))
    message_text = F.to_json(F.struct(*facts))
    pieces = (
        sent.withColumn("segment", at + 1)
        .groupBy("request_id", "session_id", "segment")
        .agg(F.array_sort(F.collect_list(F.struct("part", "position", message_text.alias("text")))).alias("held"))
    )
    joined = F.array_join(F.transform("held", lambda m: m["text"]), ",")
    comma = F.when(F.col("segment") > 1, ",").otherwise("")  # the system message comes first
    pieces = pieces.select("request_id", "session_id", "segment", F.concat(comma, joined).alias("text"))

    def fields(*names) -> Column:
        """Members as they stand inside an object, without its braces."""
        return F.regexp_extract(F.to_json(F.struct(*names)), r"(?s)^\{(.*)\}$", 1)

    head = F.concat(F.lit("{"), fields("model"), F.when(F.col("model").isNotNull(), ",").otherwise(""), F.lit('"messages":['))
    tail = F.concat(F.lit("],"), fields(tools.alias("tools"), F.lit("auto").alias("tool_choice"), "stream"), F.lit("}"))
    ends = requests.select(
        "request_id",
        "session_id",
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("long").alias("segment"), head.alias("text")),
                F.struct(F.lit(1 << 60).cast("long").alias("segment"), tail.alias("text")),
            )
        ),
    )
    return pieces.unionByName(ends)


def _part(part: int, role: str, content: Column) -> Column:
    return F.struct(
        F.lit(part).alias("part"),
        F.lit(0).cast("long").alias("position"),
        F.lit(role).alias("role"),
        content.alias("content"),
    )


def drop_failed(
    messages: DataFrame, failed_runs: DataFrame, keys: tuple[str, ...] = ("run_id",)
) -> DataFrame:
    """A run that raised stores nothing; ``keys`` together name a run."""
    return spread_join(messages, failed_runs.select(*keys).distinct(), list(keys), "left_anti")


def session_memory(
    messages: DataFrame, order: str = "turn", sizes: tuple[int, ...] | None = None
) -> DataFrame:
    """Stored list of every session: ``session_id, position, run_no, role, content``.

    Further columns of ``messages``, such as ``tool_name`` and ``tool_calls``, stay; they
    are NULL in the system messages. Messages without a session form one of their own.

    A user message opens a run. Each run prepends another system message to a list that
    already starts with those of earlier runs, so ``n`` of them lead after ``n`` runs.
    The list as it was after run ``r`` is the rows with ``run_no <= r``.
    """
    facts = [c for c in messages.columns if c not in ("session_id", "role", "content", order)]
    numbered = number_rows(
        messages.select("session_id", F.col(order).alias("__at"), "role", "content", *facts),
        ["session_id"],
        "__at",
        F.col("role") == "user",
        sizes,
    )
    run_no = F.col("start_no").alias("run_no")
    return numbered.select(
        "session_id",
        lead_and_turn(
            lead=[(F.col("start_no") - 1).alias("position"), run_no],
            turn=[(F.col("n_starts") + F.col("row_no") - 1).alias("position"), run_no],
            facts=[numbered.schema[c] for c in facts],
        ),
    )


def lead_and_turn(
    lead: list[Column], turn: list[Column], facts: Sequence[T.StructField] = ()
) -> Column:
    """Rows a message adds to its session's list, with their places given by the caller.

    Every message adds itself; one that opens a run also adds a leading system message.
    """
    first = F.struct(
        *lead,
        F.lit("system").alias("role"),
        F.lit(fixed.SYSTEM_TEXT).alias("content"),
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in facts),
    )
    kept = [F.col(c).alias(c) for c in ("role", "content", *(f.name for f in facts))]
    own = F.struct(*turn, *kept)
    opens = F.col("role") == "user"
    return F.inline(F.when(opens, F.array(first, own)).otherwise(F.array(own)))
