"""Shards of near-equal size by best-fit-decreasing packing of indivisible groups.

Rows with equal texts form a group and stay together. Groups of equal size are a run, and
what is packed on the driver are the runs, of which there are as many as distinct sizes: a
run's groups go in bulk to the shard with the least remaining capacity that still holds
one, found in a balanced tree, until it holds no more, which is where they would go
one by one. A group then gets its shard by its rank among those of its size. The capacity is
the smallest found for which that needs no more than the shards asked for; groups larger than
an equal share of what is left get a shard of their own first.

There are fewer distinct sizes than the square root of twice the table's bytes, so the driver holds
a small part of any table: the one method serves tables of every size. Above ``MAX_SIZES`` of them
the places are joined by a shuffle instead of a broadcast, which changes no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from askloom.llm.stored import release, stored
from askloom.plans.ordered import number_rows
from askloom.plans.skew import spread_join

MAX_SIZES = 1 << 16
SEARCH_STEPS = 14


@dataclass
class Node:
    key: tuple[int, int]  # remaining capacity, bin
    rank: int
    left: Node | None = None
    right: Node | None = None


class Tree:
    """A treap of ``(remaining capacity, bin)``: ordered by key, heap-ordered by rank."""

    def __init__(self):
        self.root: Node | None = None
        self._rank = 1

    def _next_rank(self) -> int:
        self._rank = self._rank * 48271 % 2147483647
        return self._rank

    def _split(self, node: Node | None, key: tuple) -> tuple[Node | None, Node | None]:
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self._split(node.right, key)
            return node, rest
        rest, node.left = self._split(node.left, key)
        return rest, node

    def _merge(self, a: Node | None, b: Node | None) -> Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def add(self, key: tuple[int, int]) -> None:
        below, above = self._split(self.root, key)
        self.root = self._merge(self._merge(below, Node(key, self._next_rank())), above)

    def take_at_least(self, room: int) -> tuple[int, int] | None:
        """Remove and return the least key with that much room."""
        below, above = self._split(self.root, (room, -1))
        if above is None:
            self.root = below
            return None
        node = above
        while node.left:
            node = node.left
        _, rest = self._split(above, (node.key[0], node.key[1] + 1))
        self.root = self._merge(below, rest)
        return node.key


Run = tuple[int, int]  # size of an item, how many of it


def best_fit_runs(runs: list[Run], capacity: int, most: int | None = None) -> list[list[Run]] | None:
    """For each run of items, by falling sizes, the bins they go to and how many to each.

    An item larger than ``capacity`` has a bin of its own. None if more than ``most`` bins
    would be needed. A bin that took an item is the tightest one still, as long as it
    holds another, so it takes as many as it can at once.
    """
    tree, bins, out = Tree(), 0, []
    for size, left in runs:
        out.append([])
        while left:
            found = tree.take_at_least(size)
            if found is None:
                if bins == most:
                    return None
                found = (max(capacity, size), bins)
                bins += 1
            n = min(left, found[0] // size)
            out[-1].append((found[1], n))
            tree.add((found[0] - n * size, found[1]))
            left -= n
    return out


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; ``sizes`` must fall. A larger item has a bin of its own."""
    return [bins[0][0] for bins in best_fit_runs([(x, 1) for x in sizes], capacity)]


def tightest_runs(runs: list[Run], shards: int) -> list[list[Run]]:
    """Best fit of falling runs into at most ``shards`` bins, of the smallest capacity found.

    Items larger than an equal share of what is left have a bin of their own.
    """
    alone: list[list[Run]] = [[] for _ in runs]
    rest, total, used = list(runs), sum(x * n for x, n in runs), 0
    for i, (size, n) in enumerate(runs):
        while n and size * (shards - used) > total and used < shards - 1:
            alone[i].append((used, 1))
            used, total, n = used + 1, total - size, n - 1
        rest[i] = (size, n)
        if n:
            break
    if not total:
        return alone
    shards -= used
    low = max(-(-total // shards), next(x for x, n in rest if n))
    high, best = 2 * low, None
    for _ in range(SEARCH_STEPS):
        capacity = (low + high) // 2 if best else low
        placed = best_fit_runs(rest, capacity, shards)
        if placed is not None:
            best, high = placed, capacity
        else:
            low = capacity + 1
            if best is None:  # twice the lower bound always suffices
                best = best_fit_runs(rest, high, shards)
        if low >= high:
            break
    return [x + [(bin_ + used, n) for bin_, n in y] for x, y in zip(alone, best)]


def tightest(sizes: list[int], shards: int) -> list[int]:
    """The bins of single items, as ``tightest_runs`` places them."""
    return [bins[0][0] for bins in tightest_runs([(x, 1) for x in sizes], shards)]


def _ranges(runs: list[Run], placed: list[list[Run]]):
    """``size, first, last, shard``: which ranks among the groups of a size go to a shard."""
    for (size, _), bins in zip(runs, placed):
        first = 1
        for bin_, n in bins:
            yield size, first, first + n - 1, bin_
            first += n


def shard_by_bytes(
    spark: SparkSession, docs: DataFrame, shards: int = 16, max_sizes: int = MAX_SIZES
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Size is the text's UTF-8 bytes plus one. A null text counts as empty, so null and empty
    texts form one group; a null ``doc_id`` stays null; repeated rows get slots of their
    own; an empty table gives no rows; other columns are ignored. A group larger than an
    equal share keeps a shard to itself, which then is larger than the others, which share
    the rest equally.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        spark,
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("group"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.min("at").alias("at"))
    groups = stored(spark, groups, "shard-groups")
    runs = groups.groupBy("size").agg(F.count("*").alias("n")).collect()  # a row per distinct size
    sizes = sorted(((r["size"], r["n"]) for r in runs), reverse=True)
    ranges = spark.createDataFrame(
        list(_ranges(sizes, tightest_runs(sizes, shards))), "of long, first long, last long, shard int"
    )
    if len(sizes) <= max_sizes:
        ranges = F.broadcast(ranges)  # at most shards rows a size
    ranked = number_rows(groups.select("group", "size", "at"), ["size"], "at", F.lit(False))
    own = (F.col("size") == F.col("of")) & F.col("row_no").between(F.col("first"), F.col("last"))
    places = stored(spark, ranked.join(ranges, own).select("group", "shard"), "group-shards")
    in_shards = spread_join(rows, places, "group").drop("group")
    in_shards = stored(spark, in_shards, "rows-in-shards")  # numbering reads it twice
    release(rows, groups, places)
    return number_rows(in_shards, ["shard"], "at", F.lit(False)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row_no") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
