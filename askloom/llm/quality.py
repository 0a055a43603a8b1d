"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it, so rules may run in any order, and a rule needs
to see only what the rules before it let pass. On a bounded sample each rule's cost and
rejections are measured; the cascade then runs the rule with most rejections per second
first, next the one with most among the documents left, and so on. The order changes the
cost and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askloom.llm import textkernel

SAMPLE_ROWS = 1000  # documents on which costs and rejections are measured
SAMPLE_BYTES = 1 << 16  # longer texts are not taken into the sample
REPEAT_WORDS = 8
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words",
)


@dataclass
class View:
    """Features of the rows of a run, each computed only for the rows that ask for it."""

    run: textkernel.Run
    _words: textkernel.Words | None = None
    _arrays: dict = field(default_factory=dict)

    @property
    def words(self) -> textkernel.Words:
        if self._words is None:
            self._words = textkernel.words(self.run)
        return self._words

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        values, done = self._arrays.setdefault(
            name, (np.zeros(len(self.run), np.int64), np.zeros(len(self.run), bool))
        )
        missing = rows[~done[rows]]
        if len(missing):
            values[missing] = getattr(self, f"_{name}")(missing)
            done[missing] = True
        return values[rows]

    def _count(self, mask: np.ndarray, rows: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.run.offsets[rows + 1]] - sums[self.run.offsets[rows]]

    def _n_words(self, rows: np.ndarray) -> np.ndarray:
        return self.words.bounds[rows + 1] - self.words.bounds[rows]

    def _word_chars(self, rows: np.ndarray) -> np.ndarray:
        continued = (self.run.data & 0xC0) == 0x80
        return self._count(~textkernel._SPACE[self.run.data] & ~continued, rows)

    def _n_symbols(self, rows: np.ndarray) -> np.ndarray:
        return self._count(_SYMBOLS[self.run.data], rows)

    def _n_marks(self, rows: np.ndarray) -> np.ndarray:
        return self._count(self.run.data == ord("!"), rows)

    def _lines(self, row: int) -> list[bytes]:
        return [x for x in self.run.text(row).split(b"\n") if x.strip()]

    def _n_lines(self, rows: np.ndarray) -> list[int]:
        return [len(self._lines(r)) for r in rows]

    def _n_dup_lines(self, rows: np.ndarray) -> list[int]:
        lines = map(self._lines, rows)
        return [len(x) - len(set(x)) for x in lines]

    def _n_repeat_words(self, rows: np.ndarray) -> list[int]:
        every = textkernel.windows(self.words.hashes, REPEAT_WORDS, 11)
        out = []
        for a, b in zip(self.words.bounds[rows].tolist(), self.words.bounds[rows + 1].tolist()):
            own = every[a : max(a, b - REPEAT_WORDS + 1)]
            ordered = np.sort(own)
            again = ordered[1:][ordered[1:] == ordered[:-1]]
            if not len(again):
                out.append(0)
                continue
            at = np.isin(own, again).nonzero()[0]
            steps = np.diff(at, append=at[-1] + REPEAT_WORDS)
            out.append(int(np.minimum(steps, REPEAT_WORDS).sum()))
        return out


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the named features, as arrays, to a boolean array."""

    name: str
    features: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


BASE_RULES = (
    Rule("short", ("n_words",), lambda n: n < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 30 * n),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 100 * s > 20 * n),
    Rule("shouting", ("n_words", "n_marks"), lambda n, m: 100 * m > 40 * n),
    Rule("long_words", ("n_words", "word_chars"), lambda n, c: c > 15 * n),
    Rule("same_lines", ("n_lines", "n_dup_lines"), lambda n, d: 100 * d > 50 * n),
)


def judge(view: View, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which rows of a view pass; every rule sees what the earlier ones let pass."""
    passed = np.arange(len(view.run))
    for rule in rules:
        if not len(passed):
            break
        rejected = rule.rejects(*(view.get(f, passed) for f in rule.features))
        passed = passed[~rejected]
    kept = np.zeros(len(view.run), bool)
    kept[passed] = True
    return kept


def measured(texts: list[str], rules: tuple[Rule, ...]) -> list[tuple[Rule, float, int]]:
    """The rules in the order found, each with its seconds and its rejections there."""
    found = list(textkernel.runs(pa.array(texts, pa.string())))
    left = [np.arange(len(run)) for run in found]
    rest, chosen = list(rules), []
    while rest:
        best = None
        for rule in rest:
            began = time.perf_counter()
            views = [View(run) for run in found]
            hits = [
                rule.rejects(*(v.get(f, rows) for f in rule.features)) if len(rows) else rows > 0
                for v, rows in zip(views, left)
            ]
            cost = time.perf_counter() - began
            n = int(sum(h.sum() for h in hits))
            if best is None or n / max(cost, 1e-9) > best[0]:
                best = (n / max(cost, 1e-9), rule, cost, n, hits)
        _, rule, cost, n, hits = best
        chosen.append((rule, cost, n))
        left = [rows[~h] for rows, h in zip(left, hits)]
        rest.remove(rule)
    return chosen


def measured_order(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per cost on the first ``sample_rows`` texts of up to
    ``SAMPLE_BYTES`` bytes, so that the driver holds a bounded sample. Spark reads only as
    many partitions as give so many rows."""
    text = F.col("text").cast("string")
    small = docs.select(text.alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    return tuple(r for r, _, _ in measured([row[0] for row in small.take(sample_rows)], rules))


def judge_documents(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    *,
    report: tuple[str, ...] = (),
    order: tuple[Rule, ...] | None = None,
) -> DataFrame:
    """All columns of ``docs`` but ``text``, the ``report`` features and ``kept``.

    ``order`` skips the measuring. A null or empty text has no words, so the short rule
    rejects it; other nulls and repeated rows pass through; an empty table gives no rows.
    Columns of ``docs`` named like a result give way to it.
    """
    order = order or measured_order(docs, rules)
    others = [c for c in docs.columns if c not in (*report, "kept", "text")]
    fields = docs.select(*(docs[c] for c in others)).schema
    for name in report:
        fields = fields.add(name, "long")
    fields = fields.add("kept", "boolean")

    def batches_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, verdicts = {name: [] for name in report}, []
            for run in textkernel.runs(batch.column(batch.num_columns - 1)):
                view = View(run)
                verdicts.append(judge(view, order))
                for name in report:
                    features[name].append(view.get(name, np.arange(len(run))))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(np.concatenate(x or [np.zeros(0, np.int64)])) for x in features.values()]
            columns.append(pa.array(np.concatenate(verdicts or [np.zeros(0, bool)])))
            yield pa.RecordBatch.from_arrays(columns, [*others, *report, "kept"])

    return docs.select(*(docs[c] for c in others), docs["text"].cast("string")).mapInArrow(batches_out, fields)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; nulls as in ``judge_documents``."""
    order = measured_order(docs, rules)
    at = docs.columns.index("text")

    def batches_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(View(run), order) for run in textkernel.runs(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(batches_out, docs.schema)
