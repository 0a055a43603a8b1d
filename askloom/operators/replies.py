"""Rebuild replies from logged token lines; encode and decode reply frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from askloom import fixed
from askloom.functions import jsontext
from askloom.functions.text import strip
from askloom.plans.ordered import bucket_of

SEGMENT = 4096


def ndjson_tokens(lines: DataFrame) -> DataFrame:
    """Tokens of ``{"response": ...}`` lines as ``response_id, seq, token, done``.

    A missing key is an empty token; a line that is not a JSON object has a NULL token.
    Further columns, such as a time, stay.
    """
    token = jsontext.mapped("line", lambda: _response_text)
    return lines.select("response_id", "seq", *_others(lines), token.alias("token"), F.lit(False).alias("done"))


def _others(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c not in ("response_id", "seq", "line")]


def _response_text(value) -> str:
    return jsontext.token_text(value.get("response", ""))


def _delta_text(value) -> str:
    return jsontext.token_text(value["choices"][0]["delta"].get("content", ""))


def sse_tokens(lines: DataFrame) -> DataFrame:
    """Tokens of ``data: {...}`` lines, with ``done`` on the stop marker.

    Other lines and chunks without a first choice or a delta have a NULL token. Further
    columns, such as a time, stay.
    """
    prefix = fixed.SSE_PREFIX
    chunk = F.when(
        F.col("line").startswith(prefix), F.substring("line", len(prefix) + 1, 2**31 - 1)
    )
    done = F.coalesce(strip("chunk") == fixed.SSE_DONE, F.lit(False))
    return (
        lines.select("response_id", "seq", *_others(lines), chunk.alias("chunk"))
        .withColumn("done", done)
        .select(
            "response_id",
            "seq",
            *_others(lines),
            jsontext.mapped(F.when(~F.col("done"), F.col("chunk")), lambda: _delta_text).alias("token"),
            "done",
        )
    )


def segments(tokens: DataFrame, size: int = SEGMENT) -> DataFrame:
    """First step: join the tokens of each run of ``size`` sequence numbers.

    The shuffle key includes the segment, so a reply with a third of all lines is
    sorted and joined in many tasks. ``text`` ends at the stop marker, if one is seen.
    """
    numbered = tokens.withColumn("segment", bucket_of("seq", size))
    grouped = numbered.groupBy("response_id", "segment").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("token").isNotNull(), F.struct("seq", "token")))
        ).alias("parts"),
        F.min(F.when(F.col("done"), F.col("seq"))).alias("stop"),
    )
    before = F.filter("parts", lambda p: F.col("stop").isNull() | (p["seq"] < F.col("stop")))
    text = F.array_join(F.transform(before, lambda p: p["token"]), "")
    return grouped.select(
        "response_id", "segment", text.alias("text"), F.col("stop").isNotNull().alias("stopped")
    )


def once_each(tokens: DataFrame) -> DataFrame:
    """One row per ``(response_id, seq)`` of a token table in which lines may repeat."""
    return tokens.dropDuplicates(["response_id", "seq"])


def join_segments(parts: DataFrame) -> DataFrame:
    """Second step: one ``response_id, content`` row per reply from its segments."""
    grouped = parts.groupBy("response_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "text"))).alias("parts"),
        F.min(F.when(F.col("stopped"), F.col("segment"))).alias("last"),
    )
    upto = F.filter("parts", lambda p: F.col("last").isNull() | (p["segment"] <= F.col("last")))
    return grouped.select(
        "response_id", F.array_join(F.transform(upto, lambda p: p["text"]), "").alias("content")
    )


def reassemble(tokens: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Whole replies as ``response_id, content``; a reply of bad lines only is empty."""
    return join_segments(segments(tokens, size))


def reply_text(style: Column | str, body: Column | str) -> Column:
    """Answer text of a whole, non-streamed reply body."""
    style = F.col(style) if isinstance(style, str) else style
    return F.when(
        style == "chat", F.get_json_object(body, "$.choices[0].message.content")
    ).otherwise(F.get_json_object(body, "$.response"))


def encode_frame(sources: Column | str, content: Column | str) -> Column:
    """Reply frame: a JSON header with the sources, a marker line, the text.

    A reply without sources is the bare fallback text.
    """
    sources = F.col(sources) if isinstance(sources, str) else sources
    content = F.col(content) if isinstance(content, str) else content
    header = F.to_json(F.struct(sources.alias("sources")))
    framed = F.concat(header, F.lit(fixed.FRAME_MARK), content)
    return F.when(F.size(sources) > 0, framed).otherwise(fixed.NO_STREAM_ANSWER)


def decode_frame(frames: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``sources`` and ``content``; a frame without marker is all content."""
    parts = F.split(F.col(raw), fixed.FRAME_MARK, 2)
    framed = F.size(parts) == 2
    header = F.from_json(parts[0], "sources array<string>")
    none = F.array().cast("array<string>")
    return frames.withColumn(
        "sources", F.when(framed, F.coalesce(header["sources"], none)).otherwise(none)
    ).withColumn("content", F.when(framed, F.get(parts, 1)).otherwise(F.col(raw)))
