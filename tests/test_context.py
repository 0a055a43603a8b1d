import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from askloom import fixed
from askloom.operators import context, inference, knowledge
from askloom.sources import collections


@pytest.fixture
def asked(spark):
    queries = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, question string")
    hits = spark.createDataFrame(
        [(1, 2, 20, 0.41239), (1, 1, 10, 0.87654321)], "query_id int, rank int, id long, score double"
    )
    texts = spark.createDataFrame([(10, "ten"), (20, "t" * 120), (30, "other")], "id long, text string")
    return context.collect_hits(queries, context.with_text(hits, texts))


def test_context_numbers_sources_in_rank_order(asked):
    got = dict(rows(asked.select("query_id", context.context())))
    assert got == {1: "Source 1: ten\n\nSource 2: " + "t" * 120, 2: ""}


def test_prompt_wording(asked):
    got = dict(rows(asked.select("query_id", context.grounded_prompt("question"))))
    assert got[2] is None
    assert got[1] == (
        "You are a helpful assistant. Answer the question using ONLY the context provided below.\n"
        "If the context does not contain enough information, say so honestly.\n"
        "\n"
        "Context:\n"
        "Source 1: ten\n\nSource 2: " + "t" * 120 + "\n"
        "\n"
        "Question: why?\n"
        "\n"
        "Answer:"
    )


def test_knowledge_text_and_previews(asked):
    got = dict(rows(asked.select("query_id", context.knowledge_text())))
    assert got == {1: "ten\n" + "t" * 120, 2: fixed.NO_KNOWLEDGE}
    previews = dict(rows(asked.select("query_id", context.source_previews())))
    assert previews == {1: ["ten...", "t" * 100 + "..."], 2: []}


def test_answers_and_fallback(spark, asked):
    answers = spark.createDataFrame([(1, "because")], "query_id int, answer string")
    got = context.answer_records(asked, answers).orderBy("query_id").collect()
    assert [(r["question"], r["answer"], len(r["sources"])) for r in got] == [
        ("why?", "because", 2),
        ("how?", fixed.NO_ANSWER, 0),
    ]


def test_search_responses_are_written_with_rounded_scores(spark, asked, tmp_path):
    path = str(tmp_path / "out")
    context.write_search_responses(asked, path, "question")
    got = sorted((json.loads(r[0]) for r in spark.read.text(path).collect()), key=lambda r: r["query"])
    assert got == [
        {"query": "how?", "results": []},
        {
            "query": "why?",
            "results": [{"text": "ten", "score": 0.8765}, {"text": "t" * 120, "score": 0.4124}],
        },
    ]


def points(spark, data):
    df = spark.createDataFrame(data, "k long, vector array<float>, text string")
    return collections.as_points(df, F.col("k"))


def test_collections_are_created_once_replaced_and_versioned(spark, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    rejects = str(tmp_path / "rejects")
    mixed = points(spark, [(1, [3.0, 4.0], "a"), (2, [1.0], "short")])
    with pytest.raises(Exception, match="not 2 numbers wide"):
        collections.create_collection(mixed, str(tmp_path / "failed"), 2)
    collections.create_collection(mixed, old, 2, rejects=rejects)
    assert rows(spark.read.parquet(rejects).select("id", "payload.text")) == [(2, "short")]
    stored = spark.read.parquet(old)
    assert rows(stored.select("id", "norm", "payload.text", "payload.source")) == [(1, 5.0, "a", None)]
    with pytest.raises(Exception, match="already exists"):
        collections.create_collection(points(spark, [(1, [1.0, 0.0], "b")]), old, 2)
    collections.create_collection(
        points(spark, [(1, [1.0, 0.0], "b"), (2, [1.0, 1.0], "c")]), old, 2, replace=True
    )
    collections.upsert_version(spark, old, points(spark, [(2, [0.0, 1.0], "d"), (3, [1.0, 2.0], "e")]), new)
    merged = spark.read.parquet(new)
    assert rows(merged.select("id", "payload.text")) == [(1, "b"), (2, "d"), (3, "e")]
    assert collections.count_points(merged).first()[0] == 3
    twice = points(spark, [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "y")])
    assert rows(collections.upsert(merged, twice).filter("id = 1").select("payload.text")) == [("y",)]


def test_width_check_sends_everything_somewhere(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0], ""), (2, [1.0], ""), (3, None, ""), (4, [None, 1.0], ""), (5, [nan, 1.0], ""), (6, [1.0, -inf], "")]
    accepted, rejected = collections.split_by_width(points(spark, data), 2)
    assert [r[0] for r in rows(accepted.select("id"))] == [1]
    assert [r[0] for r in rows(rejected.select("id"))] == [2, 3, 4, 5, 6]


def test_chunks_and_vectors_meet_by_key(spark):
    chunks = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a"), ("e", 0, "c")], "doc_id string, chunk_index int, text string")
    vecs = spark.createDataFrame(
        [("d", 0, [0.0]), ("d", 1, [1.0])], "doc_id string, chunk_index int, vector array<float>"
    )
    joined = collections.attach_vectors(chunks, vecs)
    assert rows(joined.select("text", "vector")) == [("a", [0.0]), ("b", [1.0]), ("c", None)]


def test_lexical_vectors_are_unit_and_rank_shared_words_first(spark):
    texts = spark.createDataFrame(
        [(1, "red apple pie"), (2, "red apple tart"), (3, "blue whale"), (4, "")], "doc_id long, text string"
    )
    model = inference.fit_lexical(texts, width=64)
    got = {r["doc_id"]: r["vector"] for r in inference.embed_lexical(model, texts).collect()}
    assert all(len(v) == 64 for v in got.values())
    assert sum(x * x for x in got[1]) == pytest.approx(1.0, abs=1e-6)

    def dot(i, j):
        return sum(a * b for a, b in zip(got[i], got[j]))

    assert dot(1, 2) > dot(1, 3)


def test_generation_is_built_once_per_task_and_batched(spark):
    def make():
        sizes = []

        def answer(models, prompts):
            sizes.append(len(prompts))
            return [f"{m}/{p}/{len(sizes)}/{len(prompts)}" for m, p in zip(models, prompts)]

        return answer

    prompts = spark.range(5).coalesce(1).select(
        F.col("id").alias("query_id"), F.lit("m").alias("model"), F.col("id").cast("string").alias("prompt")
    )
    got = [r["answer"] for r in inference.generate(prompts, make, batch_size=2).orderBy("query_id").collect()]
    assert got == ["m/0/1/2", "m/1/1/2", "m/2/2/2", "m/3/2/2", "m/4/3/1"]


def test_repeated_searches_are_run_once_per_query(spark):
    calls = spark.createDataFrame(
        [
            (1, "search_knowledge_base", '{"query":"x"}'),
            (2, "search_knowledge_base", '{"query":"x"}'),
            (3, "search_knowledge_base", '{"query":"far"}'),
            (4, "search_knowledge_base", "{}"),
            (5, "calculate", '{"expression":"1"}'),
        ],
        "n int, name string, args string",
    )
    embedded = []

    def embed(queries):
        embedded.append(queries.count())
        at = F.when(F.col("query") == "x", 1.0).otherwise(-1.0).cast("float")
        return queries.withColumn("vector", F.array(at, F.lit(0.0).cast("float")))

    points = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(5)], "id long, vector array<float>")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id long, text string")
    got = knowledge.answer_searches(calls, embed, points, texts, width=2)
    assert rows(got.select("n", "result").fillna("none")) == [
        (1, "text 0\ntext 1\ntext 2"),
        (2, "text 0\ntext 1\ntext 2"),
        (3, fixed.NO_KNOWLEDGE),
        (4, "none"),
    ]
    assert embedded == [2]


def test_collection_queries_with_documents_without_vectors(spark, tmp_path):
    from askloom.checks import CHECKS

    spark.createDataFrame(
        [(1, "a\nb", "s"), (2, "c", "s")], "doc_id long, text string, source string"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [0.5] * 64)], "vec_id long, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )

    def texts(name):
        return sorted((r.text, r.norm) for r in CHECKS[name].run(spark, str(tmp_path)).collect())

    assert texts("points_build") == texts("collection_written") == [("a", 4.0), ("b", 4.0)]
    assert texts("points_rejected") == texts("collection_rejects") == [("c", None)]
