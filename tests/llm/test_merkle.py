"""Merkle manifest against a plain version, and the layout of its blocks."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import plain
from pyspark.sql import functions as F

from askloom.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def raised(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        first = at // 16 * 16
        yield level[first:at], level[at + 1 : first + 16]
        at //= 16


def plain_manifest(rows):
    """``rows`` are ``(doc_id, text, lang, source, n_chars)``."""
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        tampered = None
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            lowered = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            tampered = leaf((doc_id, source, lang, n_chars, lowered))
        trees[source].append((doc_id is not None, doc_id or 0, leaf((doc_id, source, lang, n_chars, text)), tampered))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: raised([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = raised([built[s][-1][0] for s in names])
    for n, s in enumerate(names):
        for at, (named, doc_id, own, tampered) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            node, proof = tampered or own, ""
            for before, after in [*siblings(built[s], at), *siblings(top, n)]:
                node, proof = h("".join([*before, node, *after])), proof + "".join(before + after)
            yield (doc_id if named else None, own, built[s][-1][0], top[-1][0], h(proof), node, node == top[-1][0])


def table(spark, rows):
    return spark.createDataFrame(rows, plain.SCHEMA)


def test_layout():
    for levels in (1, 2, 3, 4):
        places = [merkle.addresses(levels, d, np.arange(16**d)) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_of(levels)))
        top = levels // 2
        if top:
            assert max(p.max() for p in places[:top]) == merkle.nodes_of(top) - 1
            subtree = merkle.nodes_of(levels - top)  # bottom trees one after the other
            for d in range(top, levels):
                want = np.arange(16**d) // 16 ** (d - top)
                assert ((places[d] - merkle.nodes_of(top)) // subtree == want).all()


def test_steps_survive_packing():
    steps = [(b"ab" * 32, b""), (b"", b"cd" * 64), (b"", b""), (b"01" * 32 * 7, b"ef" * 32 * 8)]
    assert merkle.unpacked_path(b"".join(merkle.packed_step(*s) for s in steps)) == steps
    assert merkle.unpacked_path(b"") == []


def test_manifest(spark):
    rng = plain.generator()
    rows = [(i, t, "en", "odd", None) for i, t in plain.odd_rows()]
    rows += [(i, f"Text {i} ÄB", "de", None, i) for i in range(-20, 20)]
    rows += [(i, plain.prose(rng, 5) + " END", None, "big", 5) for i in rng.sample(range(10**9), 5000)]
    rows += [(i, "Z", "fr", f"s{i}", -1) for i in range(300)] + [(7, "X", "é", "\U0001f600", 0), (8, "X", "", "￿", 0), (9, "A" * 10**6, "x", "", 0)]
    docs = table(spark, rows).repartition(5).withColumns({"tree": F.lit("x"), "position": F.lit(0), "digest": F.lit(b"")})
    got = merkle.verify_documents(spark, docs)
    assert plain.collected(got) == plain.Counter(plain_manifest(rows))


def test_many_rounds(spark, monkeypatch):
    """Blocks of one level make many rounds."""
    monkeypatch.setattr(merkle, "BLOCK_HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    for sizes in ({"a": 1}, {"a": 16, "b": 17}, {"a": 4097, "b": 1, "c": 300, "d": 256}, {f"s{i:03}": 1 + i % 3 for i in range(300)}):
        rows = [(i, f"T{i}", "en", s, i) for s, n in sizes.items() for i in range(n)]
        got = merkle.verify_documents(spark, table(spark, rows))
        assert plain.collected(got) == plain.Counter(plain_manifest(rows))


def test_empty_table(spark):
    empty = merkle.verify_documents(spark, table(spark, []))
    assert empty.collect() == [] and empty.columns == [c.split()[0] for c in merkle.RESULT_SCHEMA.split(", ")]
