"""Request defaults, payloads and small formatting expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from askloom import fixed
from askloom.functions.text import col, is_blank, strip


def round_score(c: Column | str) -> Column:
    """Scores are rounded for output only, after ranking."""
    return F.round(col(c), fixed.SCORE_DIGITS)


def or_default(c: Column | str, default: str | int) -> Column:
    return F.coalesce(col(c), F.lit(default))


def or_model(c: Column | str, default: str = fixed.GENERATE_MODEL) -> Column:
    """Like ``model or default``: an empty name counts as missing."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def search_requests(df: DataFrame) -> DataFrame:
    return df.withColumn("limit", or_default("limit", fixed.TOP_K))


def agent_requests(df: DataFrame, style: Column | str | None = None) -> DataFrame:
    """Fill session and model; the model left out depends on ``style``, as in payloads."""
    model = F.lit(fixed.AGENT_MODEL)
    if style is not None:
        model = F.when(col(style) == "chat", fixed.CHAT_AGENT_MODEL).otherwise(model)
    return df.withColumn("session_id", or_default("session_id", fixed.DEFAULT_SESSION)).withColumn(
        "model", F.coalesce("model", model)
    )


def asked_questions(df: DataFrame, question: str = "question") -> DataFrame:
    """Drop blank questions and strip the others, as the input box does."""
    return df.filter(~is_blank(question)).withColumn(question, strip(question))


def request_payload(
    style: Column | str, model: Column | str, prompt: Column | str, stream: Column
) -> Column:
    """Request body as JSON text: "chat" sends messages, "generate" a prompt."""
    message = F.struct(F.lit("user").alias("role"), col(prompt).alias("content"))
    chat = F.struct(
        or_model(model).alias("model"), F.array(message).alias("messages"), stream.alias("stream")
    )
    generate = F.struct(
        or_model(model).alias("model"), col(prompt).alias("prompt"), stream.alias("stream")
    )
    return F.when(col(style) == "chat", F.to_json(chat)).otherwise(F.to_json(generate))


def is_expression(c: Column | str) -> Column:
    """True if a text holds only arithmetic characters; empty text qualifies."""
    allowed = "".join(re.escape(ch) for ch in fixed.EXPRESSION_CHARS)
    return col(c).rlike(rf"\A[{allowed}]*\z")


def format_time(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def current_time() -> Column:
    """The current time in the session time zone, as the time tool writes it."""
    return format_time(F.current_timestamp())


def weather_values(body: Column | str) -> Column:
    schema = "current struct<temperature_2m double, wind_speed_10m double>"
    return F.from_json(col(body), schema)["current"]


def weather_text(body: Column | str) -> Column:
    """Report line that keeps each number as it is written in the payload."""
    return F.concat(
        F.lit(fixed.WEATHER_TEMPERATURE),
        F.get_json_object(col(body), "$.current.temperature_2m"),
        F.lit(fixed.WEATHER_WIND),
        F.get_json_object(col(body), "$.current.wind_speed_10m"),
        F.lit(fixed.WEATHER_END),
    )
