"""Jaccard join, its one-per-group stage and the component search, against plain versions."""

from pyspark.sql import functions as F

from askloom.llm import jaccardjoin
from askloom.llm.components import connected
import plain


def near_group(rng, copies, words=80, edits=6):
    base = plain.prose(rng, words)
    return [base] + [plain.edited(rng, base, rng.randint(0, edits)) for _ in range(copies)]


def check(spark, pairs):
    got = jaccardjoin.join_similar(spark, plain.documents(spark, pairs, spread=True)).collect()
    sets = [plain.shingles(t) for _, t in pairs]
    roots = plain.components(len(pairs), plain.similar(sets))
    least = {}
    for (i, _), r in zip(pairs, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(
        (str(i), len(s), str(least.get(r) if s else i)) for (i, _), s, r in zip(pairs, sets, roots)
    )
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    return roots


def test_groups_and_clean_documents(spark):
    rng = plain.generator()
    shared = plain.prose(rng, 40)
    texts = near_group(rng, 60) + near_group(rng, 25, words=300, edits=12) + near_group(rng, 3, words=14, edits=1)
    texts += [plain.prose(rng, 50) + " " + shared + " " + plain.prose(rng, 50) for _ in range(30)]
    texts += [plain.prose(rng, n) for n in (1, 3, 5, 6, 400, 3000)]
    rng.shuffle(texts)
    roots = check(spark, list(enumerate(texts)))
    assert 40 < len(set(roots)) < len(texts)


def test_chain_of_links_is_one_component(spark):
    rng = plain.generator(5)
    words = plain.prose(rng, 100).split()
    texts = []
    for i in range(30):  # each step changes another place, so ends are far apart
        words[3 * i] = f"new{i}"
        texts.append(" ".join(words))
    roots = check(spark, list(enumerate(texts)))
    assert len(set(roots)) == 1


def test_many_copies_and_odd_rows(spark):
    rng = plain.generator(2)
    copy = plain.prose(rng, 60)
    check(spark, plain.odd_rows() + [(100 + i, copy) for i in range(300)] + [(90, plain.edited(rng, copy, 1))])


def test_case_folds_only_ascii(spark):
    check(spark, [(1, "É" + "A b c d e f g"), (2, "éA B C D E F G"), (3, "ÉA B c D E F G")])


def test_empty_table_and_other_columns(spark):
    assert jaccardjoin.join_similar(spark, plain.documents(spark, [])).collect() == []
    docs = plain.documents(spark, {1: "a b c d e f"}).withColumns({"n": F.lit("x"), "hash": F.lit(1), "set": F.lit(2)})
    assert [tuple(r) for r in jaccardjoin.join_similar(spark, docs).collect()] == [(1, 2, 1)]


def test_keep_one(spark):
    rng = plain.generator(3)
    pairs = list(enumerate(near_group(rng, 20) + [plain.prose(rng, 70) for _ in range(10)], start=10))
    pairs += [(10, pairs[0][1]), *plain.odd_rows()]
    docs = plain.documents(spark, pairs, spread=True).withColumn("row", F.lit("r")).withColumn("hash", F.lit(0))
    kept = jaccardjoin.keep_one(spark, docs)
    assert kept.columns == docs.columns
    sets = [plain.shingles(t) for _, t in pairs]
    groups = {}
    for (i, t), s, r in zip(pairs, sets, plain.components(len(pairs), plain.similar(sets))):
        if s:
            groups.setdefault(r, []).append((i is None, i))
    want = sorted(str(min(g, key=lambda x: (x[0], x[1] or 0))[1]) for g in groups.values())
    want += [str(i) for (i, _), s in zip(pairs, sets) if not s]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(want)


def test_connected(spark):
    rng = plain.generator(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    links += [(7, i) for i in range(400, 460)] + [(5, 5), (None, 3)]
    edges = spark.createDataFrame([(b, a) for a, b in links] + links[:20], "a long, b long")
    got = {r.id: r.root for r in connected(spark, edges).collect()}
    real = [x for x in links if None not in x]
    roots = plain.components(500, real)
    assert got == {i: roots[i] for i in {x for pair in real for x in pair}}
    assert connected(spark, edges.limit(0)).collect() == []
