"""Replies: conversation texts cut into logged token lines and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from askloom import fixed
from askloom.checks.registry import check, table
from askloom.operators import replies

TEXT_SQL = "SELECT conv_id || '-' || turn AS response_id, text AS content FROM conversations"


def _pieces(spark, sf_dir) -> tuple[DataFrame, Column]:
    """Each text with an array of its pieces of up to seven characters."""
    texts = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias(
            "response_id"
        ),
        "text",
    )
    return texts, F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))


def _scattered(texts: DataFrame, lines: Column) -> DataFrame:
    """Numbered lines, spread so that those of one reply lie in different partitions."""
    numbered = texts.select("response_id", F.posexplode(lines).alias("seq", "line"))
    return numbered.withColumn("seq", F.col("seq").cast("long")).repartition("seq")


def ndjson_lines(spark, sf_dir) -> DataFrame:
    """Token lines with bad ones in between, in no particular order."""
    texts, pieces = _pieces(spark, sf_dir)
    good = F.transform(pieces, lambda p: F.to_json(F.struct(p.alias("response"))))
    noisy = F.concat(
        F.array(F.lit('{"done": false}'), F.lit("not json")),
        good,
        F.array(F.lit(""), F.lit('{"response": "x"} junk'), F.lit('{"response": null}')),
    )
    return _scattered(texts, noisy)


def sse_lines(spark, sf_dir) -> DataFrame:
    """Event lines with skipped ones, a stop marker and lines after it."""
    texts, pieces = _pieces(spark, sf_dir)

    def event(token: Column) -> Column:
        choice = F.struct(F.struct(token.alias("content")).alias("delta"))
        return F.concat(
            F.lit(fixed.SSE_PREFIX), F.to_json(F.struct(F.array(choice).alias("choices")))
        )

    noisy = F.concat(
        F.array(
            F.lit(": comment"),
            F.lit('data:{"choices": [{"delta": {"content": "no blank"}}]}'),
            F.lit('data: {"choices": []}'),
            F.lit('data: {"choices": [{"delta": {}}]}'),
        ),
        F.transform(pieces, event),
        F.array(F.lit("data: [DONE]"), event(F.lit("late")), F.lit("data: [DONE]")),
    )
    return _scattered(texts, noisy)


@check(TEXT_SQL)
def reply_reassemble(spark, sf_dir):
    return replies.reassemble(replies.ndjson_tokens(ndjson_lines(spark, sf_dir)))


@check(TEXT_SQL)
def reply_reassemble_events(spark, sf_dir):
    return replies.reassemble(replies.sse_tokens(sse_lines(spark, sf_dir)))


@check(TEXT_SQL)
def reply_reassemble_segments(spark, sf_dir):
    """The same with short segments, so that every reply spans several."""
    return replies.reassemble(replies.ndjson_tokens(ndjson_lines(spark, sf_dir)), size=16)


@check(TEXT_SQL)
def reply_extract(spark, sf_dir):
    """Whole reply bodies of both styles."""
    texts, _ = _pieces(spark, sf_dir)
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    chat = F.to_json(F.struct(F.array(message).alias("choices")))
    plain = F.to_json(F.struct(F.col("text").alias("response")))
    style = F.when(F.col("response_id").endswith("0"), "chat").otherwise("generate")
    bodies = texts.withColumn("style", style).withColumn(
        "body", F.when(F.col("style") == "chat", chat).otherwise(plain)
    )
    return bodies.select("response_id", replies.reply_text("style", F.col("body")).alias("content"))


def _framed(spark, sf_dir):
    """Documents as replies; each cites its own name and a source that holds the marker."""
    sources = F.when(
        F.col("lang") != "en", F.array(F.col("source"), F.lit("a\n---\nb --- c"))
    ).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", replies.encode_frame(sources, "text").alias("raw")
    )


@check(
    f"""
SELECT doc_id, CASE WHEN lang <> 'en'
  THEN to_json({{'sources': [source, 'a' || chr(10) || '---' || chr(10) || 'b --- c']}})::VARCHAR
       || chr(10) || '---' || chr(10) || text
  ELSE '{fixed.NO_STREAM_ANSWER}' END AS raw
FROM documents
"""
)
def frame_encode(spark, sf_dir):
    return _framed(spark, sf_dir)


@check(
    f"""
SELECT doc_id, (CASE WHEN lang <> 'en' THEN 2 ELSE 0 END)::BIGINT AS n_sources,
       CASE WHEN lang <> 'en' THEN source END AS first_source,
       CASE WHEN lang <> 'en' THEN text ELSE '{fixed.NO_STREAM_ANSWER}' END AS content
FROM documents
"""
)
def frame_roundtrip(spark, sf_dir):
    return replies.decode_frame(_framed(spark, sf_dir)).select(
        "doc_id",
        F.size("sources").cast("long").alias("n_sources"),
        F.get("sources", F.lit(0)).alias("first_source"),
        "content",
    )
