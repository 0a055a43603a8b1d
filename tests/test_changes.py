"""Documents that change, and texts that are embedded once."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from askloom.operators import remembered
from askloom.sources import changes
from askloom.sources.documents import chunk

TEXTS = "doc_id long, text string, modified int"


def fresh(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in texts.items() if t is not None], "doc_id long, text string")
    return rows(chunk(docs, delimiter="\n").select("doc_id", "chunk_index", "text"))


def test_log_equals_a_fresh_build(spark, tmp_path):
    path = str(tmp_path / "log")
    changes.create_log(spark, path)
    held, logged = {}, []
    loads = [
        {1: "a\nb\nc", 2: "x\ny", 3: "one", 4: ""},
        {1: "a\nB\nc", 2: None, 3: "one"},  # one chunk differs, two go, one document stays as it is
        {1: "c", 2: "x\nz", 5: "new"},
        {1: "a\nb\nc", 9: None},
    ]
    for n, texts in enumerate(loads):
        docs = spark.createDataFrame([(k, t, 2) for k, t in texts.items()] + [(1, "stale\nrow", 1)], TEXTS)
        for _ in range(2):  # a repeated load replaces itself
            changes.log_load(spark, path, docs, n, modified="modified", delimiter="\n")
        held |= texts
        log = changes.read_log(spark, path)
        assert rows(changes.current_chunks(log)) == fresh(spark, held)
        logged.append(log.filter(F.col("load") == n).count())
    assert logged == [6, 3, 6, 3]


def test_empty_load(spark, tmp_path):
    path = str(tmp_path / "log")
    changes.create_log(spark, path, "string")
    changes.log_load(spark, path, spark.createDataFrame([], "doc_id string, text string"), 0)
    assert changes.current_chunks(changes.read_log(spark, path)).count() == 0


@pytest.fixture
def counted(tmp_path):
    calls = tmp_path / "calls"

    def make():
        def predict(texts: np.ndarray) -> np.ndarray:
            with open(calls, "a") as f:
                f.write("".join(f"{t}\n" for t in texts.reshape(-1)))
            return np.array([[len(t), 1] for t in texts.reshape(-1)], np.float32)

        return predict

    return make, lambda: calls.read_text(encoding="utf-8").splitlines() if calls.exists() else []


def test_each_text_reaches_the_model_once(spark, tmp_path, counted):
    make, calls = counted
    store = str(tmp_path / "store")
    remembered.create_store(spark, store)
    load = [(i, f"text {i % 40}") for i in range(200)] + [(300 + i, "the same") for i in range(100)] + [(500, None), (501, "")]
    for extra in ([], [(600, "one more"), (601, "text 3")], []):
        load += extra
        texts = spark.createDataFrame(load, "id long, text string").repartition(7)
        got = remembered.embed_once(texts, store, make).collect()
        assert {r.id: r.vector for r in got} == {i: None if t is None else [len(t), 1] for i, t in load} and len(got) == len(load)
        assert len(calls()) == len(set(calls())) == len({t for _, t in load if t is not None})


def test_no_texts(spark, tmp_path, counted):
    make, calls = counted
    store = str(tmp_path / "store")
    remembered.create_store(spark, store)
    none = spark.createDataFrame([], "id long, text string")
    assert remembered.embed_once(none, store, make).collect() == [] and calls() == []


def test_texts_meet_the_log_as_documents_and_holes_in_it_are_filled(spark, tmp_path):
    path = str(tmp_path / "log")
    changes.create_log(spark, path, "string")
    log = "doc_id string, chunk_index int, hash binary, text string, load long"
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    held = [("a", 0, sha("x"), "x", 0), ("a", 3, sha("w"), "w", 0), ("b", 0, sha("y"), "y", 0), ("b", 0, None, None, 1), ("c", 1, sha("z"), "z", 0)]
    before = spark.createDataFrame(held, log)
    docs = spark.createDataFrame([("a", "x\nnew"), ("b", "y"), ("c", None), (None, "n")], "doc_id string, text string")
    found = changes.chunk_changes(before, changes.last_texts(docs, None), delimiter="\n")
    got = {(r["doc_id"], r["chunk_index"], r["text"]) for r in found.collect()}
    assert got == {("a", 1, "new"), ("a", 3, None), ("b", 0, "y"), ("c", 1, None), (None, 0, "n")}
    assert "FullOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
