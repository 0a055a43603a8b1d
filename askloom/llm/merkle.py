"""A Merkle manifest of a table: one tree per group of rows, and a tree over their roots.

Rows are numbered within their group by a range shuffle of digests alone, so a group may
hold any share of the table. ``BLOCK`` neighbouring leaves make an aligned subtree, which
one task builds and stores as one row; the roots of the blocks are the leaves of the next
round. Three rounds reach 10^10 leaves of a group, and no task holds more than a block.

Inside a block, nodes lie in van Emde Boas order: a tree is split at half its height, its
top part comes first, then the bottom parts from left to right, each laid out like this in
turn. So a path from leaf to root meets few stretches of memory, whatever their size, and
``addresses`` finds a node by arithmetic from depth and index, for building as for siblings.

Proofs go down the same blocks: a block tells each of its leaves the siblings on the way
up, which the block below passes on. So a row's proof is completed where its block is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from askloom.llm.stored import stored
from askloom.plans.sizing import broadcast_if_small

# Children of a node, bytes of a digest, characters of it as text.
RUN, DIGEST, TEXT = 16, 32, 64
BLOCK_HEIGHT = 3
BLOCK = RUN**BLOCK_HEIGHT
# The fields of a leaf in order, and letters that tampering changes.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACES_BYTES = 32 << 20

BLOCK_SCHEMA = "tree long, block long, total long, nodes binary, root binary"
PATH_SCHEMA = "tree long, block long, subroot binary, path binary"
RESULT_SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def nodes_of(levels: int) -> int:
    """Nodes of a full tree with so many levels."""
    return (RUN**levels - 1) // (RUN - 1)


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of a depth's nodes in a tree of ``levels`` levels in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return addresses(top, depth, index)
    bottom, below = levels - top, RUN ** (depth - top)
    return nodes_of(top) + index // below * nodes_of(bottom) + addresses(bottom, depth - top, index % below)


def height_of(total: int) -> int:
    """Levels above the leaves of a block: as many as one root needs, or a whole block's."""
    height = 0
    while height < BLOCK_HEIGHT and RUN**height < total:
        height += 1
    return height


def hashed(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def laid_out(leaves: np.ndarray, height: int) -> np.ndarray:
    """All nodes over the leaves, ``n x DIGEST`` bytes, up to the last place in use."""
    nodes = np.zeros((nodes_of(height + 1), DIGEST), np.uint8)
    level, last = leaves, 0
    for depth in range(height, -1, -1):
        at = addresses(height + 1, depth, np.arange(len(level)))
        nodes[at] = level
        last = max(last, int(at[-1]))
        text = level.tobytes().hex().encode()
        above = [hashed(text[i : i + RUN * TEXT]) for i in range(0, len(text), RUN * TEXT)]
        level = np.frombuffer(b"".join(above), np.uint8).reshape(-1, DIGEST)
    return nodes[: last + 1]


def digests_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIGEST)


def build_block(table: pa.Table) -> pa.Table:
    """One block's row from its leaves ``tree, position, digest, total``."""
    table = table.sort_by("position")
    first = {c: table[c][0].as_py() for c in ("tree", "position", "total")}
    nodes = laid_out(digests_of(table["digest"]), height_of(first["total"]))
    row = [first["tree"], first["position"] // BLOCK, first["total"], nodes.tobytes(), nodes[0].tobytes()]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 2
    return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], names=["tree", "block", "total", "nodes", "root"])


def levels_text(nodes: bytes, count: int, height: int) -> list[bytes]:
    """The digests of every depth as text, from the root down to ``count`` leaves."""
    held = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    texts = []
    for depth in range(height, -1, -1):
        texts.append(held[addresses(height + 1, depth, np.arange(count))].tobytes().hex().encode())
        count = -(-count // RUN)
    return texts[::-1]


def around(level: bytes, i: int) -> tuple[bytes, bytes]:
    """What stands before and after node ``i`` in its run."""
    run, place = i // RUN * RUN * TEXT, i % RUN * TEXT
    return level[run : run + place], level[run + place + TEXT : run + RUN * TEXT]


def packed_step(before: bytes, after: bytes) -> bytes:
    return bytes([len(before) // TEXT, len(after) // TEXT]) + bytes.fromhex((before + after).decode())


def unpacked_path(path: bytes) -> list[tuple[bytes, bytes]]:
    steps, at = [], 0
    while at < len(path):
        before, after = path[at] * DIGEST, path[at + 1] * DIGEST
        held = path[at + 2 : at + 2 + before + after]
        steps.append((held[:before].hex().encode(), held[before:].hex().encode()))
        at += 2 + before + after
    return steps


def leaves_in(block: int, total: int) -> int:
    return min(BLOCK, total - block * BLOCK)


def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``tree, block, total, nodes, subroot, path`` a row per leaf of every block, with
    the path from that leaf up."""
    for batch in batches:
        for row in batch.to_pylist():
            count, height = leaves_in(row["block"], row["total"]), height_of(row["total"])
            texts = levels_text(row["nodes"], count, height)
            paths = [row["path"]]
            for level in texts[1:]:
                paths = [packed_step(*around(level, i)) + paths[i // RUN] for i in range(len(level) // TEXT)]
            for at in range(0, count, RUN * RUN):
                part = paths[at : at + RUN * RUN]
                first = row["block"] * BLOCK + at
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * len(part), pa.int64()),
                        pa.array(range(first, first + len(part)), pa.int64()),
                        pa.array([row["subroot"]] * len(part), pa.binary()),
                        pa.array(part, pa.binary()),
                    ],
                    ["tree", "block", "subroot", "path"],
                )


def fold_block(leaves: pa.Table, blocks: pa.Table, root: str) -> pa.Table:
    """Proof and recomputed root of each row of a block."""
    leaves = leaves.sort_by("position")
    block = blocks.to_pylist()[0]
    height = height_of(block["total"])
    texts = levels_text(block["nodes"], len(leaves), height)
    above = unpacked_path(block["path"])
    proofs = [b"".join(before + after for before, after in above)]
    for level in texts[1:height]:
        proofs = [b"".join(around(level, i)) + proofs[i // RUN] for i in range(len(level) // TEXT)]
    proven, folded = [], []
    for i, (leaf, changed) in enumerate(zip(leaves["digest"].to_pylist(), leaves["tampered"].to_pylist())):
        own = b"".join(around(texts[height], i)) + proofs[i // RUN] if height else proofs[0]
        proven.append(hashlib.sha256(own).hexdigest())
        node, at = (changed or leaf).hex().encode(), i
        for depth in range(height, 0, -1):
            before, after = around(texts[depth], at)
            node, at = hashed(before + node + after).hex().encode(), at // RUN
        for before, after in above:
            node = hashed(before + node + after).hex().encode()
        folded.append(node.decode())
    n = len(leaves)
    return pa.table(
        [
            leaves["doc_id"],
            pa.array([x.hex() for x in leaves["digest"].to_pylist()], pa.string()),
            pa.array([block["subroot"].hex()] * n, pa.string()),
            pa.array([root] * n, pa.string()),
            pa.array(proven, pa.string()),
            pa.array(folded, pa.string()),
            pa.array([x == root for x in folded], pa.bool_()),
        ],
        names=[c.split()[0] for c in RESULT_SCHEMA.split(", ")],
    )


def number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each source in a sorted partition, and the sources themselves."""
    from pyspark import TaskContext

    part, run, no, last, begun = TaskContext.get().partitionId(), -1, 0, None, False
    for batch in batches:
        sources = batch.column(0).to_pylist()
        runs, numbers = np.empty(len(sources), np.int64), np.empty(len(sources), np.int64)
        for i, source in enumerate(sources):
            if not begun or source != last:
                run, no, last, begun = run + 1, 0, source, True
            runs[i], numbers[i] = run, no
            no += 1
        columns = [pa.array([part] * len(sources), pa.int64()), pa.array(runs), pa.array(numbers)]
        yield pa.RecordBatch.from_arrays(
            [*columns, *(batch.column(i) for i in range(4))],
            ["part", "run", "no", "source", "doc_id", "digest", "tampered"],
        )


def placed_leaves(spark: SparkSession, leaves: DataFrame) -> DataFrame:
    """Rows ``source, doc_id, digest, tampered, at`` with tree, position and the tree's total.

    Trees are numbered by source, null first. Sorted partitions are numbered where they are;
    windows see one row per partition, or per partition and source.
    """
    order = ["source", "doc_id", "digest", "at"]
    schema = "part long, run long, no long, source string, doc_id long, digest binary, tampered binary"
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("source", "doc_id", "digest", "tampered")
    numbered = stored(spark, ranged.mapInArrow(number_runs, schema), "numbered-leaves")

    runs = stored(spark, numbered.groupBy("part", "run").agg(F.count("*").alias("n"), F.first("source").alias("source")), "leaf-runs")
    parts = runs.groupBy("part").agg(
        F.min_by("source", "run").alias("first"), F.max_by("source", "run").alias("last"), F.count("*").alias("runs")
    )
    by_part = Window.orderBy("part")
    goes_on = F.lag(F.lit(True), 1, False).over(by_part) & F.col("first").eqNullSafe(F.lag("last").over(by_part))
    parts = parts.withColumn("goes_on", goes_on.cast("long"))
    base = F.coalesce(F.sum(F.col("runs") - F.col("goes_on")).over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", (base - F.col("goes_on")).alias("base"))
    runs = runs.join(parts, "part").withColumn("tree", F.col("base") + F.col("run"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = runs.select("part", "run", "tree", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(tree).alias("total"))
    places = broadcast_if_small(stored(spark, places, "leaf-places"), PLACES_BYTES)
    placed = numbered.join(places, ["part", "run"]).select(
        "tree", (F.col("before") + F.col("no")).alias("position"), "total", "doc_id", "digest", "tampered"
    )
    return stored(spark, placed, "placed-leaves")


def block_no(position: str = "position") -> Column:
    return F.floor(F.col(position) / F.lit(BLOCK)).cast("long")


def build_forest(spark: SparkSession, leaves: DataFrame) -> list[DataFrame]:
    """Blocks of each round over ``tree, position, digest, total``, leaves first."""
    rounds, items = [], leaves.select("tree", "position", "digest", "total")
    while True:
        blocks = items.groupBy("tree", block_no().alias("__block")).applyInArrow(build_block, BLOCK_SCHEMA)
        rounds.append(stored(spark, blocks, "merkle-blocks"))
        higher = rounds[-1].filter(F.col("total") > BLOCK)
        if higher.isEmpty():
            return rounds
        total = F.ceil(F.col("total") / F.lit(BLOCK)).cast("long")
        items = higher.select("tree", F.col("block").alias("position"), F.col("root").alias("digest"), total.alias("total"))


def roots_of(rounds: list[DataFrame]) -> DataFrame:
    """``tree, root``: from the round in which a tree has one block."""
    alone = [b.filter(F.col("total") <= BLOCK).select("tree", "root") for b in rounds]
    return alone[0] if len(alone) == 1 else alone[0].union(roots_of(rounds[1:]))


def paths_down(spark: SparkSession, rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths above the blocks of the first round; ``tops`` has them above the trees' roots:
    ``tree, block, subroot, path`` with block 0."""
    handed = None
    for blocks in reversed(rounds):
        alone = blocks.filter(F.col("total") <= BLOCK)
        paths = alone.select("tree", "block").join(tops, ["tree", "block"])
        if handed is not None:
            paths = paths.union(hand_on(spark, *handed))
        handed = blocks, paths.select("tree", "block", "subroot", "path")
    return handed[1]


def hand_on(spark: SparkSession, blocks: DataFrame, paths: DataFrame) -> DataFrame:
    given = blocks.drop("root").join(paths, ["tree", "block"])
    return stored(spark, given.mapInArrow(hand_down, PATH_SCHEMA), "merkle-paths")


@dataclass
class Manifest:
    """Stored tables of a manifest: placed leaves, rounds of blocks of the trees and of the
    tree over their roots, and that tree's root as text (None for an empty table)."""

    leaves: DataFrame
    trees: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def build_manifest(spark: SparkSession, leaves: DataFrame) -> Manifest:
    """``leaves`` has ``source, doc_id, digest, tampered, at``; see ``document_leaves``."""
    placed = placed_leaves(spark, leaves)
    n_trees = placed.agg(F.max("tree")).first()[0]
    if n_trees is None:
        return Manifest(placed, [], [], None)
    trees = build_forest(spark, placed)
    subroots = roots_of(trees).select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), F.col("root").alias("digest"),
        F.lit(n_trees + 1).cast("long").alias("total"),
    )
    top = build_forest(spark, subroots)
    return Manifest(placed, trees, top, bytes(roots_of(top).first()["root"]).hex())


def verify(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Rows of ``RESULT_SCHEMA``: a proof for every leaf, folded from its tampered digest."""
    if manifest.root is None:
        return spark.createDataFrame([], RESULT_SCHEMA)
    none = F.lit(b"")
    first = spark.range(1).select(F.col("id").alias("tree"), F.col("id").alias("block"), none.alias("subroot"), none.alias("path"))
    above = paths_down(spark, manifest.top, first)
    above = hand_on(spark, manifest.top[0], above).select(F.col("block").alias("tree"), "path")
    tops = roots_of(manifest.trees).join(above, "tree")
    tops = tops.select("tree", F.lit(0).cast("long").alias("block"), F.col("root").alias("subroot"), "path")
    paths = paths_down(spark, manifest.trees, stored(spark, tops, "merkle-tops"))
    blocks = manifest.trees[0].drop("root").join(paths, ["tree", "block"])
    root = manifest.root
    leaves = manifest.leaves.withColumn("block", block_no()).drop("total")
    return (
        leaves.groupBy("tree", "block")
        .cogroup(blocks.groupBy("tree", "block"))
        .applyInArrow(lambda rows, block: fold_block(rows, block, root), RESULT_SCHEMA)
    )


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each with its bytes' number before it, or a mark for null."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """A digest per row, and that of the tampered row where ``doc_id`` is chosen for it."""
    values = {c: F.col(c) for c in FIELDS}
    lowered = values | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest([*values.values()]).alias("digest"),
        F.when(chosen, leaf_digest([*lowered.values()])).alias("tampered"),
        F.monotonically_increasing_id().alias("at"),
    )


def verify_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    Rows of a source are ordered by ``doc_id``, null first, rows of equal id by their leaf;
    equal leaves are interchangeable. A null ``doc_id`` is never tampered with; null sources
    form a tree of their own, which comes first; an empty table gives no rows and has no
    root; columns other than ``FIELDS`` are ignored.
    """
    leaves = stored(spark, document_leaves(docs), "leaves")
    return verify(spark, build_manifest(spark, leaves))
