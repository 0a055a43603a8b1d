"""Secrets in texts: fixed patterns, and random strings by their token efficiency.

A subword vocabulary learned from prose spells ordinary strings in few tokens, but needs
a token for every character or two of a random string. Strings of ``MIN_CHARS`` characters
and more that mix letters and digits and yield fewer than ``MAX_CHARS_PER_TOKEN``
characters per token are reported, unless they are digests, identifiers or part of a
pattern's span.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askloom.llm.workers import kept

MIN_CHARS = 20
MAX_CHARS_PER_TOKEN = 2.2
MAX_ENCODED_CHARS = 4096  # a longer string is encoded in pieces and judged as a whole

# The patterns, their order and their least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"  # whole runs of [0-9a-f]
ASSIGN_CHARS, ACCESS_CHARS = 8, 16

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS
# Known digests: hexadecimal strings of the usual lengths, and UUIDs.
DIGEST = r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
PART = r"[A-Z]+|[a-z]+|[0-9]+|[+/_=-]+"
WORD_CHARS = 3  # letters of a word in an identifier, at least

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_random long, "
    "base_sha256 string, spans string"
)


class Scanner:
    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access, self.hex, self.candidate = map(re.compile, (ACCESS, HEX, CANDIDATE))
        self.known = re.compile(f"(?:{DIGEST}|{UUID})")
        self.part = re.compile(PART)

    def chars_per_token(self, string: str) -> float:
        parts = (string[i : i + MAX_ENCODED_CHARS] for i in range(0, len(string), MAX_ENCODED_CHARS))
        return len(string) / sum(len(self.encoding.encode_ordinary(part)) for part in parts)

    def is_identifier(self, string: str) -> bool:
        """Words and numbers joined by separators or capitals, such as names, paths, slugs.

        A word is small letters, perhaps with a capital before them, or capitals alone; none
        follows a digit directly. One look at every run of equal kind decides.
        """
        before, capitals, words = "", 0, False  # capitals wait for what follows them
        for m in self.part.finditer(string):
            kind, n = _kind(m[0][0]), len(m[0])
            if kind == "a":
                if n < WORD_CHARS or before == "0" or 0 < capitals - 1 < WORD_CHARS:
                    return False
            elif 0 < capitals < WORD_CHARS:
                return False
            before, capitals, words = kind, n if kind == "A" else 0, words or kind != "-"
        return words and not 0 < capitals < WORD_CHARS

    def is_random(self, string: str) -> bool:
        classes = (str.isdigit, str.isalpha)
        if not all(any(map(c, string)) for c in classes) or self.known.fullmatch(string):
            return False
        if self.is_identifier(string):
            return False
        return self.chars_per_token(string) < MAX_CHARS_PER_TOKEN

    def base_spans(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, kind, end)`` of the fixed patterns; failing matches are consumed."""
        found = [
            (m.start(), 0, m.end())
            for m in self.assign.finditer(text)
            if len(m[2]) >= ASSIGN_CHARS
        ]
        found += [
            (m.start(), 1, m.end())
            for m in self.access.finditer(text)
            if len(m[0]) >= ACCESS_CHARS
        ]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def random_spans(self, text: str, base: list) -> list[tuple[int, int, int]]:
        """Spans of candidates that meet no base span; both lists are walked once."""
        found, at, end = [], 0, 0  # end: of the base spans that begin before the candidate does
        for m in self.candidate.finditer(text):
            a, b = m.span()
            while at < len(base) and base[at][0] <= a:
                end, at = max(end, base[at][2]), at + 1
            if end <= a and not (at < len(base) and base[at][0] < b) and self.is_random(m[0]):
                found.append((a, 3, b))
        return found


def _kind(c: str) -> str:
    return "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "-"


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_batches(
    batches: Iterator[pa.RecordBatch], vocabulary: str, pattern: str
) -> Iterator[pa.RecordBatch]:
    scanner = kept(("secrets", vocabulary, pattern), lambda: Scanner(vocabulary, pattern))
    for batch in batches:
        counts, digests, every = ([], [], [], []), [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = scanner.base_spans(text)
            random = scanner.random_spans(text, base)
            spans = sorted(base + random)
            for kind, column in enumerate(counts):
                column.append(sum(s[1] == kind for s in spans))
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            every.append(written(spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(every, pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Spans of secrets in every row of ``docs``.

    ``vocabulary`` is the path of a file of ranks and ``pattern`` the split pattern that
    goes with it. A null or empty text has no spans; a null ``doc_id`` stays null; repeated
    rows are scanned each; an empty table gives no rows; other columns are ignored. Offsets
    are code points, ends exclusive; spans that begin together follow the order of ``KINDS``.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return texts.mapInArrow(lambda b: scan_batches(b, vocabulary, pattern), SCHEMA)
