"""The registered queries: their SQL on DuckDB, and the pipeline stage by stage."""

import os
from collections import Counter
from pathlib import Path

import corpus_pipeline
import duckdb
import plain
import pytest

from askloom.llm import decontamination, linededup
from askloom.llm.queries import ORACLE_SQL, QUERIES
from askloom.llm.stored import stored

SF_DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(SF_DIR))
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(result.fetchall())


def test_there_is_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Each stage judged on what the one before it left."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    items = [decontamination.plain_shingles(r.text.encode()) for r in benchmark.collect()]
    seen = {"start": {r.doc_id: r.text for r in docs.collect()}}
    before = seen["start"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(spark, stage(spark, docs, str(SF_DIR)), name)
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "quality_rules":
            assert after.items() <= before.items() and 0.7 * len(before) < len(after) < len(before)
        elif name == "line_dedup":
            lines = [x for t in after.values() for x in t.split("\n") if len(x.split()) >= linededup.MIN_WORDS]
            assert after.keys() == before.keys() and len(set(lines)) == len(lines)
        elif name == "ngram_join":
            ids = sorted(before)
            sets = [plain.shingles(before[i]) for i in ids]
            roots = plain.components(len(ids), plain.similar(sets))
            want = {i for n, i in enumerate(ids) if not sets[n] or roots[n] == n}
            assert set(after) == want
        else:
            held = {i: decontamination.plain_shingles(t.encode()) for i, t in before.items()}
            clean = {i for i, h in held.items() if not any(x and len(x & h) >= 0.8 * len(x) for x in items)}
            assert set(after) == clean and len(clean) < len(before)
        docs, before = out, after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF_DIR)).collect()
    tokens = {r.doc_id: r.doc_tokens for r in packed}
    assert set(tokens) == set(before) and sum(r.length for r in packed) == sum(tokens.values())
    whole = corpus_pipeline.run(spark, str(SF_DIR)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == sorted(
        (r.doc_id, r.start, r.length, r.ids_crc32) for r in packed
    )
