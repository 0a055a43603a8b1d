"""Search on the inverted table equals scoring every pair of texts."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

from conftest import rows
from pyspark.sql import functions as F

from askloom.operators import lexical
from askloom.plans import sizing


def topics(rng, n):
    """Texts of forty topics with words of their own, and some common ones; some are copies."""
    out = []
    for i in range(n):
        words = [f"t{i % 40}w{rng.randrange(12)}" for _ in range(rng.randint(3, 15))] + rng.choices(["the", "of", "A", "to"], k=6)
        out.append(" ".join(words))
    return out + out[: n // 3]


def plain_search(texts, asked, limit, least):
    counts = {i: Counter(t.lower().split()) for i, t in texts if t}
    df = Counter(term for c in counts.values() for term in c)
    weight = {t: math.log((len(texts) + 1) / (n + 1)) for t, n in df.items()}

    def unit(text):
        x = {t: n * weight[t] for t, n in Counter((text or "").lower().split()).items() if weight.get(t)}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {t: v / length for t, v in x.items()}

    postings = defaultdict(list)
    for i, t in texts:
        for term, w in unit(t).items():
            postings[term].append((i, w))
    for q, text in asked:
        scores = Counter()
        for term, w in unit(text).items():
            for i, v in postings[term]:
                scores[i] += w * v
        found = sorted((-round(s, lexical.DIGITS), i) for i, s in scores.items() if round(s, lexical.DIGITS) >= least)
        yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(found[:limit]))


def test_blocks_that_cannot_win_are_left_out(spark, tmp_path):
    rng = random.Random(5)
    texts = list(enumerate(topics(rng, 900))) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "THE of\tto a")]
    asked = [(i, t) for i, t in texts if i % 50 == 0 or i >= 5000] + [(9000, "unknown words"), (9001, "t3w1 t4w2 the")]
    index = lexical.write_index(spark.createDataFrame(texts, "id long, text string").repartition(6), str(tmp_path / "index"), 32)
    found = lexical.search(spark.createDataFrame(asked, "query_id long, text string"), index)
    got = [(q, r, i, round(s, 6)) for q, r, i, s in rows(found.hits)]
    assert got == sorted((q, r, i, round(s, 6)) for q, r, i, s in plain_search(texts, asked, 3, 0.3))
    share = found.share().first()
    assert share["scored"] < 0.5 * share["postings"], share
    again = lexical.LexicalIndex.read(spark, str(tmp_path / "index"))
    low = lexical.search(spark.createDataFrame(asked, "query_id long, text string"), again, limit=20, min_score=0.01)
    assert {(q, r, i) for q, r, i, _ in rows(low.hits)} == {(q, r, i) for q, r, i, _ in plain_search(texts, asked, 20, 0.01)}


def test_nothing_to_search(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a b"), (2, "a c")], "id long, text string")
    index = lexical.write_index(texts, str(tmp_path / "index"))
    none = lexical.search(spark.createDataFrame([], "query_id long, text string"), index)
    assert none.hits.collect() == [] and none.share().first()["scored"] == 0
    empty = lexical.write_index(texts.limit(0), str(tmp_path / "empty"))
    assert lexical.search(texts.withColumnRenamed("id", "query_id"), empty).hits.collect() == []


def test_no_row_per_posting_of_a_query_is_written(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    texts = spark.createDataFrame([(i, f"{words} own{i % 7} x{i}") for i in range(400)], "id long, text string")
    index = lexical.write_index(texts, str(tmp_path / "index"))
    found = lexical.search(texts.filter("id % 4 = 0").withColumnRenamed("id", "query_id"), index)
    plan = found.hits._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "explode(entries" not in plan and "MapInArrow" in plan
    assert index.texts.count() == 400 and index.texts.filter("size(nos) <> size(xs)").count() == 0
    got = [(q, r, i) for q, r, i, _ in rows(found.hits)]
    pairs = [(r["id"], r["text"]) for r in texts.collect()]
    want = plain_search(pairs, [(i, t) for i, t in pairs if i % 4 == 0], 3, 0.3)
    assert got == sorted((q, r, i) for q, r, i, _ in want)


def test_texts_and_queries_in_turns(spark, tmp_path, monkeypatch):
    """Blocks of queries meet the texts one after the other, and term counts go once the index is written."""
    monkeypatch.setattr(sizing, "CELL_BYTES", 40 * lexical.DENSE_TERMS * sizing.NUMBER_BYTES)
    monkeypatch.setattr(lexical, "TURN_ENTRIES", 500)
    sent, folder = [], Path(spark.conf.get("spark.checkpoint.dir"))
    texts = list(enumerate(topics(random.Random(6), 300)))
    before = len(list(folder.glob("term-counts-*")))
    index = lexical.write_index(spark.createDataFrame(texts, "id long, text string"), str(tmp_path / "index"), 32)
    assert len(list(folder.glob("term-counts-*"))) == before
    assert index.texts.count() == len(texts) and index.texts.select("id").distinct().count() == len(texts)
    cells = lexical._cells
    monkeypatch.setattr(lexical, "_cells", lambda *a: (sent.append(cells(*a)), sent[-1])[1])
    found = lexical.search(spark.createDataFrame(texts, "query_id long, text string"), index)
    assert [(q, r, i) for q, r, i, _ in rows(found.hits)] == sorted((q, r, i) for q, r, i, _ in plain_search(texts, texts, 3, 0.3))
    turns = sent[1:]
    assert len(turns) > 4 and all(c.filter(F.col("kind") == lexical.TEXTS).count() == len(texts) for c in turns)
