"""Contexts, prompts, answers and search responses.

Questions are asked with the reversed vectors of the whole embeddings table; the
collection is all documents: with their vector of the table, else with a lexical one. The
higher threshold leaves some questions without hits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom import fixed
from askloom.checks.registry import check, table
from askloom.checks.vector_checks import WIDTH
from askloom.operators import context, inference, knowledge, search
from askloom.plans import scratch

MIN_SCORE = 0.35

COLLECTION_SQL = f"""
terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) AS term
  FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)),
counts AS (
  SELECT doc_id, (('0x' || substr(md5(term), 1, 16))::UBIGINT % {WIDTH})::BIGINT AS slot, count(*) AS n
  FROM terms GROUP BY ALL),
units AS (SELECT doc_id, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT AS x FROM counts),
dense AS (
  SELECT doc_id, list(coalesce(u.x, 0)::DOUBLE ORDER BY s.slot) AS v
  FROM (SELECT DISTINCT doc_id FROM units) d CROSS JOIN range({WIDTH}) s(slot)
  LEFT JOIN units u USING (doc_id, slot) GROUP BY doc_id),
collection AS (
  SELECT doc_id AS id, coalesce(embedding::DOUBLE[], dense.v) AS v, text
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN dense USING (doc_id)
  WHERE embedding IS NOT NULL OR dense.v IS NOT NULL)"""

HITS_SQL = f"""
WITH asked AS (
  SELECT vec_id AS query_id, 'What is known about topic ' || label || '?' AS question,
         list_reverse(embedding)::DOUBLE[] AS v
  FROM embeddings),
{COLLECTION_SQL},
scored AS (
  SELECT query_id, id, text, list_cosine_similarity(asked.v, collection.v) AS score
  FROM asked, collection),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM scored WHERE score >= {MIN_SCORE}),
hits AS (SELECT * FROM ranked WHERE rank <= 3),
grouped AS (
  SELECT query_id, count(*) AS n,
         string_agg('Source ' || rank || ': ' || text, repeat(chr(10), 2) ORDER BY rank) AS context,
         string_agg(text, chr(10) ORDER BY rank) AS lines,
         list(left(text, 100) || '...' ORDER BY rank) AS previews,
         list({{'text': text, 'score': round(score, 4)}} ORDER BY rank) AS results
  FROM hits GROUP BY query_id),
joined AS (SELECT * FROM asked LEFT JOIN grouped USING (query_id))
"""

PROMPT_SQL = f"""
'{fixed.PROMPT_HEAD}' || context || '{fixed.PROMPT_QUESTION}' || question || '{fixed.PROMPT_TAIL}'
"""


def asked(spark, sf_dir):
    """Questions with their ranked hits as an array."""
    vecs = table(spark, sf_dir, "embeddings")
    documents = table(spark, sf_dir, "documents")
    questions = vecs.select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("What is known about topic "), F.col("label").cast("string"), F.lit("?")).alias(
            "question"
        ),
        F.reverse("embedding").alias("vector"),
    )
    hits = stored(
        search.top_k(questions.select("query_id", "vector"), collection(spark, sf_dir), width=WIDTH, min_score=MIN_SCORE), "hits"
    )
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    return context.collect_hits(
        questions.select("query_id", "question"), context.with_text(hits, texts)
    )


def stored(df, name):
    """``df`` written once, as the joins that follow read it several times."""
    path = scratch.new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def collection(spark, sf_dir):
    """A vector for every document: its own, else a lexical one of the same width."""
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    others = documents.join(vecs, "id", "left_anti").repartition(spark.sparkContext.defaultParallelism)
    lexical = inference.embed_lexical([1.0] * WIDTH, others).select("id", "vector")
    return stored(vecs.join(documents, "id", "left_semi").unionByName(lexical), "collection")


@check(HITS_SQL + "SELECT query_id, coalesce(context, '') AS context, coalesce(n, 0) AS n_hits FROM joined")
def context_build(spark, sf_dir):
    return asked(spark, sf_dir).select(
        "query_id",
        context.context().alias("context"),
        F.size("hits").cast("long").alias("n_hits"),
    )


@check(HITS_SQL + f"SELECT query_id, {PROMPT_SQL} AS prompt FROM joined")
def grounded_prompt(spark, sf_dir):
    return asked(spark, sf_dir).select(
        "query_id", context.grounded_prompt("question").alias("prompt")
    )


@check(HITS_SQL + f"SELECT query_id, coalesce(lines, '{fixed.NO_KNOWLEDGE}') AS knowledge FROM joined")
def kb_text(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", context.knowledge_text().alias("knowledge"))


@check(HITS_SQL + "SELECT query_id, i - 1 AS pos, previews[i] AS preview FROM joined, "
       "unnest(range(1, len(previews) + 1)) AS u(i)")
def source_previews(spark, sf_dir):
    exploded = asked(spark, sf_dir).select(
        "query_id", F.posexplode(context.source_previews()).alias("pos", "preview")
    )
    return exploded.withColumn("pos", F.col("pos").cast("long"))


@check(
    HITS_SQL
    + "SELECT query_id, to_json({'query': question, 'results': coalesce(results, [])})::VARCHAR"
    " AS response FROM joined"
)
def search_json(spark, sf_dir):
    return asked(spark, sf_dir).select(
        "query_id", context.search_response("question").alias("response")
    )


@check(
    f"""
WITH wanted AS (
  SELECT event_id, json_extract_string(props, '$.k') AS query FROM events WHERE event_type <> 'error'),
{COLLECTION_SQL},
scored AS (
  SELECT q.vec_id::VARCHAR AS query, id, text,
         list_cosine_similarity(list_reverse(q.embedding)::DOUBLE[], collection.v) AS score
  FROM embeddings q, collection),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank
  FROM scored WHERE score >= {MIN_SCORE}),
answers AS (
  SELECT query, string_agg(text, chr(10) ORDER BY rank) AS result
  FROM ranked WHERE rank <= 3 GROUP BY query)
SELECT event_id, md5(coalesce(result, '{fixed.NO_KNOWLEDGE}')) AS result_hash
FROM wanted LEFT JOIN answers USING (query)
"""
)
def tool_searches(spark, sf_dir):
    """Every event but errors as a search call; its query names the vector to search with."""
    vecs = table(spark, sf_dir, "embeddings")
    documents = table(spark, sf_dir, "documents")
    calls = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "other").otherwise(knowledge.SEARCH_TOOL).alias("name"),
        F.to_json(F.struct(F.get_json_object("props", "$.k").alias("query"))).alias("args"),
    )
    named = vecs.select(
        F.col("vec_id").cast("string").alias("query"), F.reverse("embedding").alias("vector")
    )
    answered = knowledge.answer_searches(
        calls,
        lambda queries: queries.join(named, "query"),
        collection(spark, sf_dir),
        documents.select(F.col("doc_id").alias("id"), "text"),
        width=WIDTH,
        min_score=MIN_SCORE,
    )
    return answered.select("event_id", F.md5("result").alias("result_hash"))


def make_counting_model():
    """Deterministic stand-in for a model: reports sizes of the prompt."""

    def answer(models: list[str], prompts: list[str]) -> list[str]:
        return [f"{m}: {len(p)} characters, {p.count(chr(10))} breaks" for m, p in zip(models, prompts)]

    return answer


ANSWER_SQL = f"""
'{fixed.GENERATE_MODEL}: ' || length({PROMPT_SQL}) || ' characters, '
|| length({PROMPT_SQL}) - length(replace({PROMPT_SQL}, chr(10), '')) || ' breaks'
"""


@check(
    HITS_SQL
    + f"SELECT query_id, question, coalesce({ANSWER_SQL}, '{fixed.NO_ANSWER}') AS answer,"
    " coalesce(array_to_string(previews, chr(30)), '') AS sources FROM joined"
)
def answer_records(spark, sf_dir):
    """Search, prompt, batch generation and the answer record with its fallback."""
    questions = asked(spark, sf_dir)
    prompts = questions.select(
        "query_id",
        F.lit(fixed.GENERATE_MODEL).alias("model"),
        context.grounded_prompt("question").alias("prompt"),
    ).filter("prompt IS NOT NULL")
    answers = inference.generate(prompts, make_counting_model)
    records = context.answer_records(questions, answers)
    return records.select(
        "query_id", "question", "answer", F.array_join("sources", "\x1e").alias("sources")
    )
