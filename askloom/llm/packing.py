"""Hierarchical packing of documents into windows of several lengths.

Every document becomes token ids and an end id. Full windows of the longest tier are cut
off it; what is left is routed to the shortest tier that holds it. Tiers are packed from
the longest down: each piece of a tier opens a window, and the gap behind it is filled
with the largest pieces of the shorter tiers that still fit, in the end with part of one.
So all windows are exactly full except what remains at the end of a task. Windows of a
tier are then dealt to step groups of equal token count, so that every group gets its
share of windows with long pieces, whose attention costs most.

Tasks pack on their own and no ids cross the network: padding is at most one window per
tier and task. Window ids hold the partition's number, which a retried task repeats.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from askloom.llm import textkernel
from askloom.llm.wordtokens import words_of

TIERS = (256, 512, 1024, 2048)
END_ID = 1
GROUP_TOKENS = 1 << 16  # tokens of a step group
BUFFER_TOKENS = 1 << 21  # tokens packed at once in a task

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)


class Shelf:
    """Waiting pieces by length, largest that fits first."""

    def __init__(self):
        self.lengths: list[int] = []
        self.pieces: dict[int, list] = defaultdict(list)

    def add(self, piece) -> None:
        length = piece[2]
        if not self.pieces[length]:
            insort(self.lengths, length)
        self.pieces[length].append(piece)

    def take(self, most: int):
        """The largest piece of at most ``most`` tokens, or None."""
        at = bisect_right(self.lengths, most) - 1
        if at < 0:
            return None
        length = self.lengths[at]
        piece = self.pieces[length].pop()
        if not self.pieces[length]:
            self.lengths.pop(at)
        return piece


class Packer:
    """Packs the pieces of one task; ``windows`` are lists of pieces with their tier.

    A piece is ``(document, start, length)``; a document is ``(doc_id, ids)``.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers)
        self.shelf = Shelf()
        self.waiting = 0
        self.windows: list[tuple[int, list]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        document, total, longest = (doc_id, ids), len(ids) // 4, self.tiers[-1]
        full = total // longest
        for i in range(full):
            self.windows.append((longest, [(document, i * longest, longest)]))
        if total > full * longest:
            self.shelf.add((document, full * longest, total - full * longest))
        self.waiting += total

    def pack(self, last: bool = False) -> None:
        """Turn waiting pieces into full windows; what can't fill one waits, or ends."""
        for i in range(len(self.tiers) - 1, -1, -1):
            tier, below = self.tiers[i], self.tiers[i - 1] if i else 0
            while self.shelf.lengths and self.shelf.lengths[-1] > below:
                window, room = [], tier
                while room:
                    piece = self.shelf.take(room)
                    if piece is None:
                        piece = self._cut(room)
                        if piece is None:
                            break
                    window.append(piece)
                    room -= piece[2]
                if room and not last:
                    for piece in window:
                        self.shelf.add(piece)
                    break
                if room:
                    self._close(window)
                else:
                    self.windows.append((tier, window))
        self.waiting = 0

    def _cut(self, room: int):
        """Part of the shortest waiting piece; the rest goes on waiting."""
        if not self.shelf.lengths:
            return None
        document, start, length = self.shelf.take(self.shelf.lengths[0])
        self.shelf.add((document, start + room, length - room))
        return document, start, room

    def _close(self, window: list) -> None:
        """A last window that isn't full goes to full windows of shorter tiers and one rest."""
        total = sum(p[2] for p in window)
        for tier in [*reversed(self.tiers), total % self.tiers[0] or self.tiers[0]]:
            while total >= tier and window:
                part, room = [], tier
                while room:
                    document, start, length = window.pop(0)
                    used = min(room, length)
                    part.append((document, start, used))
                    if used < length:
                        window.insert(0, (document, start + used, length - used))
                    room -= used
                total -= tier
                self.windows.append((self.tiers[0] if tier < self.tiers[0] else tier, part))

    def grouped(self, counts: dict[int, int], group_tokens: int) -> Iterator[tuple[int, int, list]]:
        """``(tier, group number, window)``: windows by falling attention cost, dealt to
        and fro over the groups; ``counts`` keeps the next free group of each tier."""
        by_tier = defaultdict(list)
        for tier, window in self.windows:
            by_tier[tier].append(window)
        self.windows = []
        for tier, windows in sorted(by_tier.items()):
            windows.sort(key=lambda w: -sum(p[2] * p[2] for p in w))
            groups = -(-len(windows) // max(1, group_tokens // tier))
            for i, window in enumerate(windows):
                turn, at = divmod(i, groups)
                yield tier, counts[tier] + (groups - 1 - at if turn % 2 else at), window
            counts[tier] += groups


def pack_batches(
    batches: Iterator[pa.RecordBatch], vocabulary: str, tiers: tuple[int, ...], group_tokens: int
) -> Iterator[pa.RecordBatch]:
    words = words_of(vocabulary)
    packer = Packer(tiers)
    base = TaskContext.get().partitionId() << 32
    counts: dict[int, int] = defaultdict(int)
    made = 0

    def rows() -> pa.RecordBatch:
        nonlocal made
        out = []
        for tier, group, window in packer.grouped(counts, group_tokens):
            at = 0
            for (doc_id, ids), start, length in window:
                crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                out.append((doc_id, start, length, crc, len(ids) // 4, base + made, at, tier, base + group))
                at += length
            made += 1
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        columns = list(zip(*out)) or [()] * 9
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for run in textkernel.runs(batch.column(1)):
            for i, ids in enumerate(words.row_ids(run, END_ID)):
                packer.add(doc_ids[run.first + i], ids)
                if packer.waiting >= BUFFER_TOKENS:
                    packer.pack()
                    yield rows()
    packer.pack(last=True)
    yield rows()


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    tiers: tuple[int, ...] = TIERS,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Pieces of documents with their place: one row per piece.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. A null or empty text is its end id alone, a null ``doc_id`` stays null, repeated
    rows are packed each, an empty table gives no rows. ``vocabulary`` is the path of a
    tokenizer file that all workers can read. ``tiers`` should be powers of two.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda batches: pack_batches(batches, vocabulary, tiers, group_tokens), SCHEMA
    )
