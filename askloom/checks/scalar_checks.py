"""Formatting, payload parsing and predicates over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.checks.registry import check, table
from askloom.functions import scalars


@check("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS written FROM events")
def format_ts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.format_time("ts").alias("written")
    )


def _weather(spark, sf_dir):
    body = F.concat(
        F.lit('{"latitude": 1, "current": {"temperature_2m": '),
        F.col("value").cast("string"),
        F.lit(', "wind_speed_10m": '),
        F.get_json_object("props", "$.k"),
        F.lit("}}"),
    )
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"))


@check(
    """
SELECT event_id, 'Temperature: ' || value || '°C, Wind: ' || json_extract_string(props, '$.k')
       || ' km/h' AS report
FROM events
"""
)
def weather_text(spark, sf_dir):
    return _weather(spark, sf_dir).select("event_id", scalars.weather_text("body").alias("report"))


@check(
    """
SELECT event_id, value AS temperature, json_extract_string(props, '$.k')::DOUBLE AS wind FROM events
"""
)
def json_extract(spark, sf_dir):
    values = scalars.weather_values("body")
    return _weather(spark, sf_dir).select(
        "event_id",
        values["temperature_2m"].alias("temperature"),
        values["wind_speed_10m"].alias("wind"),
    )


@check(
    r"""
WITH written AS (
  SELECT event_id, CASE event_type
    WHEN 'error' THEN props
    WHEN 'view' THEN value || ' * (' || json_extract_string(props, '$.k') || ' - 1)'
    WHEN 'click' THEN value || chr(10)
    WHEN 'signup' THEN '' ELSE value || '+a' END AS expression
  FROM events)
SELECT event_id, regexp_full_match(expression, '[-0-9+*/(). ]*') AS allowed FROM written
"""
)
def whitelist(spark, sf_dir):
    value, k = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    expression = (
        F.when(kind == "error", F.col("props"))
        .when(kind == "view", F.concat(value, F.lit(" * ("), k, F.lit(" - 1)")))
        .when(kind == "click", F.concat(value, F.lit("\n")))
        .when(kind == "signup", F.lit(""))
        .otherwise(F.concat(value, F.lit("+a")))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.is_expression(expression).alias("allowed")
    )
