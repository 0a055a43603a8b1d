"""Documents whose word shingles have a Jaccard similarity of at least ``t``.

Sets of equal shingles are one set, named by a digest. A set ``x`` of ``n`` shingles may
lack at most ``n - ceil(t * n)`` of them in any partner. This bound is used three times:

1. *Lonely sets.* Shingles that no other set holds are lacking in every partner. They are
   counted among the shingles below a fixed hash value, the same for all sets that could
   be partners, so the count is exact for that part; sets with too many have no partner.
   This needs one aggregation and drops nearly all documents.
2. *Prefixes under several global orders.* Under any one order of all shingles, partners
   share one of their first ``n - ceil(t * n) + 1``. The first order puts the rarest first
   and makes groups of sets that share a prefix shingle. The second and third are rising
   and falling hash values. A pair is compared only if it passes all three.
3. *Sizes.* With ``u`` lonely shingles in each, the overlap is at most ``min(n - u)``; and
   in each class of shingles by hash, at most the lesser number of such shingles there.

Only components are wanted, so groups aren't turned into all their pairs (``linking``);
pivots are the sets with the smallest share of lonely shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askloom.llm import marks, textkernel
from askloom.llm.linking import linked_groups
from askloom.llm.stored import stored
from askloom.plans.skew import spread_join

SHINGLE = 5
PERCENT = 80  # least Jaccard similarity in percent
SMALL = 128  # below this size all shingles count, above it those under SHARE
SHARE = 0.3
SHAPE = 32  # hash classes of shingles, in each of which overlap is bounded
_SHARE_END = int(SHARE * (1 << 63))


def lacking(n, percent: int):
    """Most shingles of a set of ``n`` that a partner may lack: ``n - ceil(t * n)``."""
    return n - -(-percent * n // 100)


def token_sets(run: textkernel.Run, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row, as non-negative 64-bit integers."""
    for found in textkernel.shingle_sets(textkernel.words(run, lower=True), k):
        yield (found >> np.uint64(1)).view(np.int64)


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def owner_of(name: bytes, n: int) -> int:
    """A set's number in counting; odd if all its shingles count."""
    return int.from_bytes(name[:8], "big", signed=True) & -2 | (n < SMALL)


def sketch_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, owners = [], [], []
        for run in textkernel.runs(batch.column(2)):
            for tokens in token_sets(run, k):
                name = digest(tokens) if len(tokens) else None
                sizes.append(len(tokens))
                digests.append(name)
                owners.append(owner_of(name, len(tokens)) if name else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(owners, pa.int64())],
            ["row", "hash", "n", "set", "owner"],
        )


def sample_batches(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """``owner, token`` for the shingles on which sets are counted."""
    full_below = -(-SMALL * 100 // percent)  # partners of small sets show all of theirs too
    for batch in batches:
        for run in textkernel.runs(batch.column(0)):
            owners, parts = [], []
            for tokens in token_sets(run, k):
                if not len(tokens):
                    continue
                owner = owner_of(digest(tokens), len(tokens))
                if len(tokens) >= full_below:
                    tokens = tokens[: np.searchsorted(tokens, _SHARE_END)]
                owners.append(np.full(len(tokens), owner, np.int64))
                parts.append(tokens)
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(owners)), pa.array(np.concatenate(parts))], ["owner", "token"]
                )


def set_batches(batches: Iterator[pa.RecordBatch], table, k: int) -> Iterator[pa.RecordBatch]:
    """The whole sets of documents whose mark is in the table."""
    for batch in batches:
        near = marks.marked(table.value, batch.column(1).to_numpy()).nonzero()[0]
        batch = batch.take(pa.array(near))
        digests, sets = [], []
        for run in textkernel.runs(batch.column(2)):
            for tokens in token_sets(run, k):
                digests.append(digest(tokens) if len(tokens) else None)
                sets.append(tokens)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
            ["row", "hash", "set", "tokens"],
        )


def link_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that share prefixes under both hash orders and reach the similarity."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        lists = []
        for i in (2, 3):
            column = batch.column(i)
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            lists.append([values[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
        for i, (x, y) in enumerate(zip(*lists)):
            p, q = lacking(len(x), percent) + 1, lacking(len(y), percent) + 1
            if not _meet(x[:p], y[:q]) or not _meet(x[-p:], y[-q:]):
                continue
            shared = len(x) + len(y) - len(textkernel.distinct(np.concatenate((x, y))))
            keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _meet(x: np.ndarray, y: np.ndarray) -> bool:
    return len(textkernel.distinct(np.concatenate((x, y)))) < len(x) + len(y)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough."""
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return both.mapInArrow(lambda b: link_batches(b, percent), "a long, b long")


def similar_sets(spark: SparkSession, sets: DataFrame, percent: int) -> DataFrame:
    """``id, root`` for the sets that have partners; ``sets`` is a stored table ``id, tokens``."""
    tokens = sets.select("id", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").cast("int").alias("df"))
    repeated = tokens.join(counts.filter("df > 1"), "token")
    found = repeated.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found")  # at most one set
    )
    ranked = found.join(sets.select("id", F.size("tokens").alias("n")), "id")
    ranked = ranked.withColumn("u", F.col("n") - F.size("found"))
    room = lacking_column(F.col("n"), percent) + 1 - F.col("u")
    ranked = (
        ranked.filter(room > 0)
        .select("id", "n", "u", F.slice("found.token", F.lit(1), room).alias("keys"), F.col("found.token").alias("found"))
        .mapInArrow(shape_batches, "id long, n int, u int, keys array<long>, shape array<int>")
    )
    ranked = stored(spark, ranked, "ranked-sets")
    members = ranked.select(F.explode("keys").alias("key"), "id", (F.col("u") / F.col("n")).alias("rank"), "n", "u")
    return linked_groups(
        spark,
        members,
        lambda pairs: linked(pairs, sets, percent),
        fits(percent),
        ranked.select("id", "shape"),
        agree(percent),
    )


def shape_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the last column, lists of shingles, how many lie in each of ``SHAPE`` hash classes."""
    for batch in batches:
        column = batch.column(4)
        values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        shapes = [np.bincount(values[a:b] % SHAPE, minlength=SHAPE) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(shapes, pa.list_(pa.int32()))], ["id", "n", "u", "keys", "shape"]
        )


def agree(percent: int):
    """Whether the shingles that other sets hold too can overlap enough, class by class."""

    def column(x: str, y: str) -> Column:
        both = F.zip_with("shape" + x, "shape" + y, lambda a, b: F.least(a, b))
        most = F.aggregate(both, F.lit(0), lambda a, b: a + b)
        return (100 + percent) * most >= percent * (F.col("n" + x) + F.col("n" + y))

    return column


def fits(percent: int):
    """Whether the sizes of two sets and of their lonely parts allow the similarity."""

    def column(x: str, y: str) -> Column:
        n, m = F.col("n" + x), F.col("n" + y)
        most = F.least(n - F.col("u" + x), m - F.col("u" + y))
        return (100 + percent) * most >= percent * (n + m)

    return column


def lacking_column(n: Column, percent: int) -> Column:
    return (n - F.ceil(n * percent / 100)).cast("int")


def _texts(docs: DataFrame, row: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col(row).cast("long").alias("row"), F.xxhash64(text).alias("hash"), text.alias("text"))


def components(
    spark: SparkSession, texts: DataFrame, k: int = SHINGLE, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """Stored tables ``row, hash, n, set`` of all ``texts(row, hash, text)`` and
    ``set, root, component_id`` of all sets but the empty one."""
    sketch = stored(
        spark,
        texts.mapInArrow(lambda b: sketch_batches(b, k), "row long, hash long, n long, set binary, owner long"),
        "sketches",
    )
    by_set = stored(
        spark,
        sketch.filter("n > 0")
        .groupBy("set")
        .agg(
            F.first("n").alias("n"), F.first("owner").alias("owner"),
            F.min(F.struct("row", "hash")).alias("held"), F.min("row").alias("least"),
        ),
        "distinct-sets",
    )

    tokens = texts.select("text").mapInArrow(lambda b: sample_batches(b, k, percent), "owner long, token long")
    lonely = (
        tokens.groupBy("token")
        .agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
        .filter(F.col("owner") == F.col("other"))
        .filter((F.col("owner") % 2 != 0) | (F.col("token") < _SHARE_END))
        .groupBy("owner")
        .agg(F.count("*").alias("alone"))
    )
    place = [F.coalesce("row", F.lit(-(1 << 63))).alias("row"), "hash"]
    candidates = stored(
        spark,
        by_set.join(lonely, "owner", "left")
        .filter(F.coalesce("alone", F.lit(0)) <= lacking_column(F.col("n"), percent))
        .select("held.*")
        .select(*place),
        "candidates",
    )
    table = marks.bit_table(spark, candidates, "hash")
    sets = texts.mapInArrow(
        lambda b: set_batches(b, table, k), "row long, hash long, set binary, tokens array<long>"
    )
    sets = sets.select(*place, "set", "tokens").join(candidates, ["row", "hash"], "left_semi")
    sets = sets.dropDuplicates(["row", "hash"]).select(F.monotonically_increasing_id().alias("id"), "set", "tokens")
    sets = stored(spark, sets, "candidate-sets")
    roots = similar_sets(spark, sets.select("id", "tokens"), percent)
    roots = sets.select("id", "set").join(roots, "id").select("set", "root")

    placed = by_set.select("set", "least").join(roots, "set", "left")
    named = F.coalesce(F.col("root").cast("string").cast("binary"), F.col("set"))  # a set is longer than any number
    placed = stored(spark, placed.withColumn("root", named), "set-roots")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_name = spread_join(placed, names, "root").select("set", "root", "component_id")
    return sketch, stored(spark, by_name, "set-components")


def join_similar(
    spark: SparkSession, docs: DataFrame, *, k: int = SHINGLE, percent: int = PERCENT, row: str = "doc_id"
) -> DataFrame:
    """``row, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the least ``row`` value in the component. A null or text without
    words has no shingles and is linked with nothing; a text of fewer than ``k`` words is
    one shingle; a null ``row`` value stays null but passes links on and never names a
    component of others; repeated rows and equal texts are linked; an empty table gives no
    rows; other columns are ignored.
    """
    sketch, by_name = components(spark, _texts(docs, row), k, percent)
    final = spread_join(sketch.select("row", "n", "set"), by_name, "set", "left")
    return final.select(
        F.col("row").alias(row),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("row")).alias("component_id"),
    )


def keep_one(
    spark: SparkSession, docs: DataFrame, *, k: int = SHINGLE, percent: int = PERCENT, row: str = "doc_id"
) -> DataFrame:
    """``docs`` with one row of each component, the one with the least ``row`` value.

    All columns stay. Rows without words are in no component and all stay. Null ``row``
    values come last; of rows that repeat the ``row`` value and text one stays.
    """
    sketch, by_name = components(spark, _texts(docs, row), k, percent)
    placed = spread_join(sketch.filter("n > 0"), by_name.select("set", "root"), "set").select("row", "hash", "root")
    placed = stored(spark, placed, "placed-rows")
    order = F.struct(F.col("row").isNull().alias("last"), "row", "hash")
    kept = placed.groupBy("root").agg(F.min(order).alias("kept"), F.count("*").alias("rows"))
    kept = stored(spark, kept.filter("rows > 1").drop("rows"), "kept-rows")
    several = spread_join(placed, kept, "root").withColumn("stays", order.eqNullSafe(F.col("kept")))
    several = several.groupBy("row", "hash").agg(F.first("stays").alias("stays"))
    several = stored(spark, several.toDF("__r", "__h", "__stays"), "decided-rows")

    table = marks.bit_table(spark, several, "__h")
    keyed = docs.withColumns({"__row": F.col(row).cast("long"), "__hash": F.xxhash64(F.col("text").cast("string"))})
    at = keyed.columns.index("__hash")

    def passing(wanted: bool) -> DataFrame:
        def batches_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = marks.marked(table.value, batch.column(at).to_numpy())
                yield batch.filter(pa.array(hit == wanted))

        return keyed.mapInArrow(batches_out, keyed.schema)

    same = F.col("__row").eqNullSafe(F.col("__r")) & (F.col("__hash") == F.col("__h"))
    gone = several.filter(~F.col("__stays"))
    left = passing(True).join(gone, same, "left_anti")
    alone = left.join(several, same, "left_anti")
    one = left.join(several, same, "left_semi").dropDuplicates(["__row", "__hash"])
    return passing(False).union(alone).union(one).select(docs.columns)
