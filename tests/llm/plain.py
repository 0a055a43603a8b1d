"""Plain versions and small tables for the tests of the training-data operators."""

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["an", "the", "ti", "on", "re", "éa", "st", "in", "wh", "ou", "ß", "ment"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(10**6))
    return " ".join(words)


def documents(spark, texts, **more):
    """A documents table with a text per id; ``None`` ids come from a list of pairs."""
    pairs = texts.items() if isinstance(texts, dict) else texts
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in pairs]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.repartition(4) if more.get("spread") else df


def odd_rows():
    """Null and empty texts, a null id, repeated rows, marks and white space alone, a long word."""
    return [
        (1, None), (2, ""), (None, "some words of a row without id here"), (3, " \n\t "),
        (4, "same text"), (4, "same text"), (5, "same text"), (6, "x" * 5000), (7, "\n\n\n"),
        (8, "é" * 300 + " \u2028 " + "ß\x1c\x85 z"), (None, None),
    ]


def shingles(text, k=5):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(folded)
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def similar(sets, percent=80):
    n = len(sets)
    return [
        (i, j)
        for i in range(n)
        for j in range(i + 1, n)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]


def repeat_words(words, k=8):
    where = defaultdict(list)
    for i in range(len(words) - k + 1):
        where[tuple(words[i : i + k])].append(i)
    return len({i + j for at in where.values() if len(at) > 1 for i in at for j in range(k)})


def collected(df):
    return Counter(tuple(r) for r in df.collect())


def generator(seed=1):
    return random.Random(seed)
