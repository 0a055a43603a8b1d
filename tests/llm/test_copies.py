"""Exact copies against a plain version."""

import hashlib
import re
from collections import defaultdict

import plain
import pytest
from pyspark.sql import functions as F

from askloom.llm import exactdedup


def plain_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for n, i in enumerate(ids):
            yield i, ids[0], len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()


def copies(rng):
    rows = plain.odd_rows() + [(100 + i, "a  b\n c") for i in range(300)] + [(50, " a b c"), (51, "a b c")]
    rows += [(60, "a b c"), (61, "a b c"), (62, "a\x1cb c"), (63, "x " * 200_000), (64, "x\t" * 200_000)]
    return rows + [(1000 + i, plain.prose(rng, rng.randint(1, 3))) for i in range(300)]


#: The usual hash, one of three values, and one value for all.
HASHES = [exactdedup.content_hash, lambda t: F.pmod(F.length(t), F.lit(3)), lambda t: F.lit(b"x")]


@pytest.mark.parametrize("content", HASHES)
def test_copies_and_collisions(spark, content):
    rows = copies(plain.generator())
    docs = plain.documents(spark, rows, spread=True).withColumns({"key": F.lit("k"), "kept": F.lit(1), "at": F.lit(0)})
    got = exactdedup.find_copies(spark, docs, content=content)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert plain.collected(got) == plain.Counter(plain_copies(rows))


def test_dropped_copies_and_empty_table(spark):
    docs = plain.documents(spark, [(1, "a b"), (2, "a  b"), (3, "c"), (0, "a\nb"), (None, "c"), (None, "d"), (0, "c"), (0, "a b")])
    left = sorted(exactdedup.drop_copies(spark, docs).select("doc_id", "text", "lang").collect(), key=str)
    assert left == sorted([(0, "a\nb", "en"), (0, "a b", "en"), (0, "c", "en"), (None, "d", "en")], key=str)
    assert exactdedup.find_copies(spark, docs.limit(0)).collect() == []


def test_plan_is_native_and_texts_are_reduced_before_they_move(spark):
    docs = plain.documents(spark, [(i, f"t{i % 3}") for i in range(9)])
    plan = exactdedup.find_copies(spark, docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
