"""Token counts by a compiled transducer and composable chunk maps.

A state of the transducer is the word begun and not yet ended. Reading a byte of a word
moves to the longer word and emits nothing; reading white space returns to the start
state and emits the word's number of tokens. Only states that occur are determinised:
``wordtokens`` compiles the emission of a state when it is first left and keeps it.

The words of a text that fits a task are counted run by run with numpy, from the start
state. A chunk of a longer text is a map from any state to the state after it and the tokens emitted on
the way. With ``state`` the word so far, that map is::

    no white space in the chunk   state -> state + chunk,  0
    otherwise                     state -> tail,           tokens(state + head) + inner

Maps of this form compose to maps of this form, and composition is associative, so the
chunks of a long text are mapped in any task and composed in a scan over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askloom.llm import textkernel
from askloom.llm.wordtokens import WordCounts, word_counts, words_of

CHUNK_BYTES = 1 << 16  # a chunk inside a task
PART_BYTES = 1 << 20  # a longer text is spread over tasks in parts of this size
SCAN_BLOCK = 64
_SPACES = b" \t\n\r\x0b\x0c"

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
MAP_SCHEMA = "key binary, part long, cut boolean, head binary, inner long, tail binary"


class ChunkMap(NamedTuple):
    cut: bool  # whether the chunk holds white space
    head: bytes  # before the first white space; all of the chunk if there is none
    inner: int  # tokens of the words that begin and end inside
    tail: bytes  # after the last white space


IDENTITY = ChunkMap(False, b"", 0, b"")


def chunk_map(chunk: bytes, counts: WordCounts) -> ChunkMap:
    pieces = chunk.split()
    head = b"" if not chunk or chunk[0] in _SPACES else pieces[0]
    if len(head) == len(chunk):
        return ChunkMap(False, head, 0, b"")
    tail = b"" if chunk[-1] in _SPACES else pieces[-1]
    inside = pieces[bool(head) : len(pieces) - bool(tail)]
    return ChunkMap(True, head, sum(map(counts.__getitem__, inside)), tail)


def compose(a: ChunkMap, b: ChunkMap, counts: WordCounts) -> ChunkMap:
    if not a.cut and not b.cut:
        return ChunkMap(False, a.head + b.head, 0, b"")
    if not a.cut:
        return ChunkMap(True, a.head + b.head, b.inner, b.tail)
    if not b.cut:
        return ChunkMap(True, a.head, a.inner, a.tail + b.head)
    joint = a.tail + b.head
    return ChunkMap(True, a.head, a.inner + b.inner + (counts[joint] if joint else 0), b.tail)


def scan(maps: list[ChunkMap], counts: WordCounts) -> ChunkMap:
    """Compose neighbours pairwise until one map is left."""
    while len(maps) > 1:
        maps = [
            compose(maps[i], maps[i + 1], counts) if i + 1 < len(maps) else maps[i]
            for i in range(0, len(maps), 2)
        ]
    return maps[0] if maps else IDENTITY


def emitted(whole: ChunkMap, counts: WordCounts) -> int:
    """Tokens of a text from the start state to its end, which ends the last word."""
    return whole.inner + sum(counts[w] for w in (whole.head, whole.tail) if w)


def text_map(text: bytes, counts: WordCounts) -> ChunkMap:
    if len(text) <= CHUNK_BYTES:
        return chunk_map(text, counts)
    return scan(
        [chunk_map(text[i : i + CHUNK_BYTES], counts) for i in range(0, len(text), CHUNK_BYTES)],
        counts,
    )


def count_batches(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    words = words_of(vocabulary)
    for batch in batches:
        n_bytes, n_tokens = [], []
        for run in textkernel.runs(batch.column(1)):
            n_bytes.append(np.diff(run.offsets))
            n_tokens.append(words.row_counts(run))
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(np.concatenate(c or none), pa.int64()) for c in (n_bytes, n_tokens))],
            ["doc_id", "n_bytes", "n_tokens"],
        )


def part_batches(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            data = text.as_buffer().to_pybytes()
            for part, i in enumerate(range(0, len(data), part_bytes)):
                yield pa.RecordBatch.from_pydict(
                    {"key": [key.as_py()], "part": [part], "chunk": [data[i : i + part_bytes]]},
                    pa.schema([("key", pa.binary()), ("part", pa.int64()), ("chunk", pa.binary())]),
                )


def _maps(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.binary()]
    names = ["key", "part", "cut", "head", "inner", "tail"]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def map_batches(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    counts = word_counts(vocabulary)
    for batch in batches:
        parts = zip(*(batch.column(i) for i in range(3)))
        yield _maps([(k.as_py(), p.as_py(), *text_map(c.as_py(), counts)) for k, p, c in parts])


def compose_group(table: pa.Table, vocabulary: str) -> pa.Table:
    """One map of a block of neighbouring maps, numbered for the next level."""
    counts = word_counts(vocabulary)
    rows = table.sort_by("part").to_pylist()
    maps = [ChunkMap(r["cut"], r["head"], r["inner"], r["tail"]) for r in rows]
    whole = scan(maps, counts)
    return pa.Table.from_batches([_maps([(rows[0]["key"], rows[0]["part"] // SCAN_BLOCK, *whole)])])


def count_tokens(docs: DataFrame, vocabulary: str, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row.

    A null or empty text has no bytes and no tokens; a null ``doc_id`` stays null; repeated
    rows are counted each; an empty table gives no rows; other columns are ignored.
    Texts beyond ``part_bytes`` are cut into parts, mapped in separate tasks and composed
    on two levels of ``SCAN_BLOCK`` maps, enough for the longest string Spark holds.
    Equal long texts are counted once.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    is_long = F.coalesce(F.octet_length("text") > part_bytes, F.lit(False))
    short = texts.filter(~is_long).mapInArrow(lambda b: count_batches(b, vocabulary), SCHEMA)

    key = F.unhex(F.sha2("text", 256)).alias("key")
    parts = (
        texts.filter(is_long)
        .select(key, "text")
        .dropDuplicates(["key"])
        .mapInArrow(lambda b: part_batches(b, part_bytes), "key binary, part long, chunk binary")
        .repartition("key", "part")
    )
    maps = parts.mapInArrow(lambda b: map_batches(b, vocabulary), MAP_SCHEMA)
    for _ in range(2):
        block = F.floor(F.col("part") / SCAN_BLOCK).alias("block")
        maps = maps.groupBy("key", block).applyInArrow(
            lambda t: compose_group(t, vocabulary), MAP_SCHEMA
        )
    totals = maps.mapInArrow(lambda b: total_batches(b, vocabulary), "key binary, n_tokens long")
    long = texts.filter(is_long).select("doc_id", key, F.octet_length("text").cast("long").alias("n_bytes"))
    return short.unionByName(long.join(totals, "key").drop("key"))


def total_batches(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    counts = word_counts(vocabulary)
    for batch in batches:
        rows = batch.to_pylist()
        totals = [emitted(ChunkMap(r["cut"], r["head"], r["inner"], r["tail"]), counts) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(totals, pa.int64())], ["key", "n_tokens"]
        )
