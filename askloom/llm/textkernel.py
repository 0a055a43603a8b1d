"""Word and shingle hashes of whole Arrow text columns, computed with numpy inside tasks.

A column is walked in runs of rows of about ``RUN_BYTES``; within a run the text is
hashed in blocks cut at white space, so that the working arrays stay small however long
one text is. Words are maximal runs of bytes other than space and ``\\x09-\\x0D``. Null
texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
BLOCK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BARE = _LOWER.copy()
_BARE[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20
_powers: dict[int, np.ndarray] = {}
_constants: dict[tuple[int, int], np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_constants(n: int, seed: int) -> np.ndarray:
    if (n, seed) not in _constants:
        raw = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003 & _MASK)
        _constants[n, seed] = mixed(raw * np.uint64(_BASE)) | np.uint64(1)
    return _constants[n, seed]


def _power_table(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, BLOCK_BYTES + 1)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        _powers[base] = held
    return held[:n]


@dataclass
class Run:
    """Some rows of a column: their bytes end to end, and where each row begins."""

    first: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def runs(column: pa.Array, max_bytes: int = RUN_BYTES) -> Iterator[Run]:
    """Split a string column into runs of whole rows; only a longer row exceeds the size."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Run(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a run in order: 64-bit hash, row within the run, byte range."""

    hashes: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of row i are bounds[i]:bounds[i + 1]


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(data):
        stop = min(start + BLOCK_BYTES, len(data))
        while stop < len(data):
            near = _SPACE[data[stop : stop + BLOCK_BYTES]].nonzero()[0]
            if len(near):
                stop += int(near[0])
                break
            stop = min(stop + BLOCK_BYTES, len(data))
        yield start, stop
        start = stop


def words(run: Run, lower: bool = False, bare: bool = False) -> Words:
    """Hash every word; a row end is a word end.

    ``lower`` folds A-Z first; ``bare`` does so too and takes ASCII punctuation as space.
    """
    hashes, starts, ends = [], [], []
    table = _BARE if bare else _LOWER if lower else None
    for a, b in _blocks(run.data):
        block = run.data[a:b]
        if table is not None:
            block = table[block]
        inside = np.zeros(b - a + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[block]
        edge = inside[1:] != inside[:-1]
        starts_here = edge & inside[1:]
        ends_here = edge & inside[:-1]
        cuts = run.offsets[(run.offsets > a) & (run.offsets < b)] - a
        cuts = cuts[inside[cuts] & inside[cuts + 1]]  # words of two rows that touch
        starts_here[cuts] = True
        ends_here[cuts] = True
        s, e = starts_here.nonzero()[0], ends_here.nonzero()[0]
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, b - a), out=sums[1:])
        h = (sums[e] - sums[s]) * _power_table(_BASE_INVERSE, b - a + 1)[s]
        hashes.append(mixed(h))
        starts.append(s + a)
        ends.append(e + a)
    if not hashes:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, empty, np.zeros(len(run) + 1, np.int64))
    s = np.concatenate(starts)
    bounds = np.searchsorted(s, run.offsets)
    rows = np.repeat(np.arange(len(run)), np.diff(bounds))
    return Words(np.concatenate(hashes), rows, s, np.concatenate(ends), bounds)


def windows(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every ``k`` neighbouring words; window ``i`` starts at word ``i``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(seed & _MASK))
    for j, c in enumerate(odd_constants(k, seed)):
        total += hashes[j : j + n] * c
    return mixed(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats numpy's hashing here."""
    ordered = np.sort(values)
    if len(ordered) < 2:
        return ordered
    fresh = np.empty(len(ordered), dtype=bool)
    fresh[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    return ordered[fresh]


def shingle_sets(found: Words, k: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct ``k``-word shingles; fewer words make one of them all."""
    every = windows(found.hashes, k, 7)
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        if b - a >= k:
            yield distinct(every[a : b - k + 1])
        else:
            yield windows(found.hashes[a:b], b - a, 7 + b - a) if b > a else every[:0]
