"""The knowledge-base search tool, run for all logged calls at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from askloom import fixed
from askloom.operators import context, search
from askloom.plans import scratch
from askloom.plans.skew import spread_join

SEARCH_TOOL = "search_knowledge_base"


def answer_searches(
    calls: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    points: DataFrame,
    texts: DataFrame,
    *,
    width: int = fixed.VECTOR_WIDTH,
    tool: str = SEARCH_TOOL,
    min_score: float = fixed.MIN_SCORE,
) -> DataFrame:
    """Calls of the search tool with their ``result`` text.

    ``embed`` adds ``vector`` to a ``query`` column. Each distinct query is embedded and
    searched once, however many calls repeat it. The parsed calls and the ranked hits are
    written to the shared folder, as the joins read each of them several times.
    """
    asked = calls.filter(F.col("name") == tool).withColumn(
        "query", F.get_json_object("args", "$.query")
    )
    asked = _stored(asked, "search-calls")
    queries = asked.select("query").filter("query IS NOT NULL").distinct()
    name = F.sha2("query", 256).alias("query_id")
    keyed = embed(queries).select(name, "vector")
    hits = _stored(search.top_k(keyed, points, width=width, limit=fixed.TOP_K, min_score=min_score), "hits")
    answered = context.collect_hits(
        queries.select(name, "query"), context.with_text(hits, texts)
    )
    results = answered.select("query", context.knowledge_text().alias("result"))
    return spread_join(asked, results, "query", "left").drop("query")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch.new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
