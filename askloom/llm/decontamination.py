"""Test items found inside documents by size-partitioned min-wise sketches.

An item's shingles are put in order by hash, and its sketch is the least of them: a
bottom-m MinHash sketch. Items are partitioned by size, each partition holding items
within a factor of two; m is fixed per partition by its largest size ``u`` and the least
containment ``t``, as one more than the most shingles that an item found in a document may
lack: ``m = u - ceil(t * u) + 1``. So a document holding ``t`` of an item's shingles holds
one of its sketch, whatever the document's length, and no item is missed.

An item of fewer words than a shingle is one shingle whole, as long as it is; it is found
where a document has just these words in a row.

Documents stay where they are. The sketches of a block of items, of a fixed size, go to
every task, where each shingle of each document is looked up in them; an item whose sketch
is hit is then compared by its shingles' words, and counts if the document holds ``t`` of
them. More items make more blocks, and a pass over the documents for each, whose result
is stored before the next block is read. A worker builds the index of a block once.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from askloom.llm import textkernel
from askloom.llm.stored import stored
from askloom.llm.workers import only

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 32 << 20  # text of the items that go to all tasks at once
SCHEMA = "item_id long, shared long, item_shingles long, containment double"
_WORD = re.compile(rb"[^\x20\x09-\x0D!-/:-@\[-`{-~]+")


def plain_shingles(text: bytes, k: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The shingles as words: A-Z folded, ASCII punctuation and white space between words."""
    words = [w.lower() for w in _WORD.findall(text)]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


class Sketches:
    """Sketches of items whose shingles have ``k`` words, partitioned by size."""

    def __init__(self, items: list[tuple[int, np.ndarray]], containment: float, k: int):
        self.k = k
        by_class: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for at, hashes in items:
            by_class[len(hashes).bit_length()].append((at, hashes))
        entries = []
        for members in by_class.values():
            largest = max(len(h) for _, h in members)
            m = largest - math.ceil(containment * largest) + 1
            entries += [(int(x), at) for at, h in members for x in h[:m]]
        entries.sort()
        self.keys = np.array([x for x, _ in entries], np.uint64)
        self.items = np.array([at for _, at in entries], np.int64)
        self.bits = np.zeros(1 << 16, bool)  # a first test that most shingles fail
        self.bits[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` and items, for every sketch value met."""
        near = self.bits[(hashes >> np.uint64(48)).astype(np.int64)].nonzero()[0]
        low = np.searchsorted(self.keys, hashes[near], side="left")
        counts = np.searchsorted(self.keys, hashes[near], side="right") - low
        at = np.repeat(near, counts)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        return at, self.items[np.repeat(low, counts) + inside]


class ItemIndex:
    """One block of items: sketches for every length of shingles, and the shingles' words."""

    def __init__(self, items: list[tuple[int, bytes]], containment: float, k: int):
        self.containment = containment
        self.ids, self.shingles, self.widths = [], [], []
        by_width: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            run = next(iter(textkernel.runs(pa.array([text.decode()]))))
            words = textkernel.words(run, bare=True).hashes
            if len(words):
                width = min(k, len(words))
                by_width[width].append((len(self.ids), textkernel.distinct(textkernel.windows(words, width, 7))))
                self.ids.append(item_id)
                self.shingles.append(plain_shingles(text, width))
                self.widths.append(width)
        self.sketches = [Sketches(members, containment, width) for width, members in sorted(by_width.items())]

    def found(self, run: textkernel.Run) -> Iterator[tuple[int, int, int, int]]:
        """``(row, item_id, shared, item_shingles)`` of each item inside a row."""
        words = textkernel.words(run, bare=True)
        pairs = set()
        for sketches in self.sketches:
            at, items = sketches.hits(textkernel.windows(words.hashes, sketches.k, 7))
            inside = at + sketches.k <= words.bounds[words.rows[at] + 1]
            pairs.update(zip(words.rows[at[inside]].tolist(), items[inside].tolist()))
        seen, held = -1, {}
        for row, item in sorted(pairs):
            if row != seen:
                seen, held = row, {}
            width = self.widths[item]
            if width not in held:
                held[width] = plain_shingles(run.text(row), width)
            whole = self.shingles[item]
            shared = len(whole & held[width])
            if shared >= self.containment * len(whole) - 1e-9:
                yield row, self.ids[item], shared, len(whole)


def index_of(held, version: str, containment: float, k: int) -> ItemIndex:
    return only("benchmark items", (version, containment, k), lambda: ItemIndex(held.value, containment, k))


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """All items in blocks of about ``block_bytes``, one at a time on the driver."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for i in range(blocks):
        rows = items.filter(block == i).collect() if blocks > 1 else items.collect()
        yield [(r["item_id"], r["text"].encode()) for r in rows]


def find_items(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    containment: float = CONTAINMENT,
    k: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``item_id, shared, item_shingles, containment``:
    one row for each item inside a document.

    Null and empty texts hold nothing and items without words are in nothing; a null ``doc_id``
    or ``item_id`` stays null; repeated documents give a row each, repeated items one; empty
    tables give no rows. Columns of ``docs`` named like a result give way.
    """
    own = ("item_id", "shared", "item_shingles", "containment", "text")
    others = [c for c in docs.columns if c not in own]
    fields = docs.select(*(docs[c] for c in others)).schema
    for name, kind in (x.split() for x in SCHEMA.split(", ")):
        fields = fields.add(name, kind)
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    items = items.filter(F.col("text").isNotNull()).distinct()

    def searched(held) -> DataFrame:
        version = uuid.uuid4().hex

        def batches_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(held, version, containment, k)
            for batch in batches:
                rows, found = [], []
                for run in textkernel.runs(batch.column(batch.num_columns - 1)):
                    for row, *rest in index.found(run):
                        rows.append(run.first + row)
                        found.append(rest)
                kept = batch.take(pa.array(rows, pa.int64()))
                ids, shared, sizes = list(zip(*found)) or ((), (), ())
                columns = [kept.column(i) for i in range(batch.num_columns - 1)]
                columns += [pa.array(x, pa.int64()) for x in (ids, shared, sizes)]
                columns.append(pa.array([a / b for a, b in zip(shared, sizes)], pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, fields.names)

        return docs.select(*(docs[c] for c in others), docs["text"].cast("string")).mapInArrow(batches_out, fields)

    found, last = None, None
    for block in item_blocks(items, block_bytes):
        if last is not None:  # there are more: store this block's rows before the next is held
            part = stored(spark, last, "items-found")
            found = part if found is None else found.unionByName(part)
        last = searched(spark.sparkContext.broadcast(block))
    return last if found is None else found.unionByName(last)


def drop_contaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options
) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns.

    Each block of items is a pass that drops rows where they are; nulls as in ``find_items``.
    """
    containment, k = options.get("containment", CONTAINMENT), options.get("k", SHINGLE)
    at = docs.columns.index("text")
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    items = items.filter(F.col("text").isNotNull()).distinct()

    def without(docs: DataFrame, held) -> DataFrame:
        version = uuid.uuid4().hex

        def batches_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(held, version, containment, k)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for run in textkernel.runs(batch.column(at)):
                    for row, *_ in index.found(run):
                        keep[run.first + row] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(batches_out, docs.schema)

    for block in item_blocks(items, options.get("block_bytes", BLOCK_BYTES)):
        docs = without(docs, spark.sparkContext.broadcast(block))
    return docs
