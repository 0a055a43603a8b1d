"""Ranked hits to contexts, grounded prompts, answers and search responses.

A query has at most ``limit`` hits, so a query's group is small whatever the table
size. Queries without hits stay, by a left join from the query table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from askloom import fixed
from askloom.functions.scalars import round_score
from askloom.functions.text import preview
from askloom.plans.skew import spread_join


def with_text(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Fetch the text of each hit after ranking; ``texts`` holds one ``id, text`` per id.

    One point may be the hit of very many queries, so its hits are spread. A hit whose
    text is missing keeps its rank and has an empty text.
    """
    found = spread_join(hits, texts.select("id", "text"), "id", "left")
    return found.withColumn("text", F.coalesce("text", F.lit("")))


def collect_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Add ``hits``: each query's ``rank, text, score`` in rank order, or an empty array."""
    grouped = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text", "score"))).alias("hits")
    )
    hit_type = grouped.schema["hits"].dataType
    empty = F.array().cast(hit_type)
    return queries.join(grouped, "query_id", "left").withColumn("hits", F.coalesce("hits", empty))


def context(hits: Column | str = "hits") -> Column:
    """Numbered sources, parted by blank lines; empty without hits."""
    numbered = F.transform(
        hits, lambda h: F.format_string(fixed.SOURCE_LINE, h["rank"], h["text"])
    )
    return F.array_join(numbered, "\n\n")


def source_previews(hits: Column | str = "hits") -> Column:
    return F.transform(hits, lambda h: preview(h["text"]))


def grounded_prompt(question: Column | str, hits: Column | str = "hits") -> Column:
    """Prompt text for a question with hits; NULL without any."""
    q = F.col(question) if isinstance(question, str) else question
    filled = F.concat(
        F.lit(fixed.PROMPT_HEAD),
        context(hits),
        F.lit(fixed.PROMPT_QUESTION),
        q,
        F.lit(fixed.PROMPT_TAIL),
    )
    return F.when(F.size(hits) > 0, filled)


def knowledge_text(hits: Column | str = "hits") -> Column:
    """Hit texts as a tool returns them: one per line, without numbering."""
    joined = F.array_join(F.transform(hits, lambda h: h["text"]), "\n")
    return F.when(F.size(hits) > 0, joined).otherwise(fixed.NO_KNOWLEDGE)


def answer_records(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """``query_id, question, answer, sources``; ``answers`` holds ``query_id, answer``.

    Questions without hits never reach a model and get the fixed fallback.
    """
    joined = asked.join(answers.select("query_id", "answer"), "query_id", "left")
    return joined.select(
        "query_id",
        "question",
        F.when(F.size("hits") > 0, F.col("answer")).otherwise(fixed.NO_ANSWER).alias("answer"),
        source_previews().alias("sources"),
    )


def search_response(query: Column | str, hits: Column | str = "hits") -> Column:
    """Search response as JSON text with rounded scores."""
    q = F.col(query) if isinstance(query, str) else query
    results = F.transform(
        hits, lambda h: F.struct(h["text"].alias("text"), round_score(h["score"]).alias("score"))
    )
    return F.to_json(F.struct(q.alias("query"), results.alias("results")))


def write_search_responses(asked: DataFrame, path: str, query: str = "query") -> None:
    """Sink of one JSON response per query."""
    asked.select(search_response(query).alias("value")).write.text(path)
