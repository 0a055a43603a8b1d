"""Parts of documents written to files and read back, against a plain version."""

import pytest
from pyspark.sql import functions as F

from askloom.checks import CHECKS, collection_checks
from askloom.plans import scratch

ODD = ["a\n# gone\n\n b ", "", None, "\n\n# gone\nc", "# gone", "d\n", "e\r\nf\n\n\n", None, "g"]


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    """Two sources with ids from -200 on, and the folder that files are written to."""
    docs = [(i, f"s{i % 2}", ODD[i % len(ODD)]) for i in range(-200, 3000)]
    data = spark.createDataFrame(docs, "doc_id long, source string, text string")
    data.orderBy(F.rand(1)).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(scratch, "new_path", lambda spark, name: str(tmp_path / "scratch" / name))
    parts = {}
    for i, source, text in docs:
        parts.setdefault((source, i // 64), []).append(text)
    return tmp_path, parts


def files(folder):
    return [p for p in folder.rglob("*.txt") if not p.name.startswith(".")]


def test_read_files(spark, written):
    path, parts = written
    got = CHECKS["read_files"].run(spark, str(path)).collect()
    want = {k: "".join((t or "").replace("\r\n", "\n") + "\n" for t in texts) for k, texts in parts.items()}
    assert {(r.source, r.part): r.text for r in got} == want and len(got) == len(want) == 102
    assert len(files(path / "scratch" / "files")) <= 8


def paragraphs(texts):
    """Chunks of a part; a text that is missing leaves one line end, which the next paragraph begins with."""
    whole = "\n".join("" if t is None else t.replace("\r\n", "\n").replace("\n", "\n\n") + "\n" for t in texts) + "\n"
    return [x.strip() for x in whole.split("\n\n") if x.strip() and not x.startswith("#")]


def test_large_files(spark, written):
    path, parts = written
    got = CHECKS["large_files"].run(spark, str(path)).collect()
    want = {(*k, i): x for k, texts in parts.items() for i, x in enumerate(paragraphs(texts))}
    assert len(got) == len(want)
    assert {(r.source, r.part, r.chunk_index): r.text for r in got} == want
    assert len(files(path / "scratch" / "large-files")) <= 8


def test_long_documents_have_files_of_few_parts(spark, written, monkeypatch):
    path, parts = written
    monkeypatch.setattr(collection_checks, "FILE_BYTES", 1000)
    got = CHECKS["read_files"].run(spark, str(path)).collect()
    assert len(got) == len(parts) and len(files(path / "scratch" / "files")) >= 30
