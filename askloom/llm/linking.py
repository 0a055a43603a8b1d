"""Components of things that share keys and pass a comparison, without all pairs of a group.

Every member is first compared with one pivot: of the best-ranked members of its groups
that fit it, the best. Links found make components. Groups with the same largest component
then become one, so that a pair which shares many keys is met once. Members of that
component need no comparison with each other; each other member is compared with those
members of the joint group that are in another component and fit: first one pair for every
two components, then the pairs whose components are still apart. So no link between two
components is missed, and few pairs are compared within one. Where groups are not made one, the pairs
that fit grow with the square of a group; they are met in rounds by their hash, so that what is held of them stays
in proportion to the members, however many there are.

Long tables are joined to stored tables with a row per key, so that Spark can split the
partitions of hot keys (adaptive skew join).
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askloom.llm.components import connected
from askloom.llm.stored import release, stored

ROUND_PAIRS = 8  # further pairs of a member that are held at once, where groups are not made one
LEAST_PAIRS = 1 << 20  # and so many at least


def linked_groups(
    spark: SparkSession,
    members: DataFrame,
    compare: Callable[[DataFrame], DataFrame],
    fits: Callable[[str, str], Column],
    profiles: DataFrame | None = None,
    agree: Callable[[str, str], Column] | None = None,
    joint: bool = True,
) -> DataFrame:
    """``id, root`` of everything linked with something.

    ``members`` is a stored table ``key, id, rank`` and more, deleted here; a low rank makes a pivot.
    Without ``joint``, groups are not made one: only members that share a key meet again.
    ``compare`` keeps the linked rows of a table of pairs ``a, b``. ``fits(x, y)`` is a
    cheap condition that linked pairs meet, on columns of ``members`` with ``x`` and ``y``
    appended to their names. ``agree`` is a closer one for the pairs that pivots leave, on
    the columns of ``profiles``, a table with a row per ``id``, as well.
    """
    facts = [c for c in members.columns if c not in ("key", "rank", "id")]
    pivots = members.groupBy("key").agg(
        F.min(F.struct("rank", "id", *facts)).alias("pivot"), F.min("id").alias("lo"), F.max("id").alias("hi")
    )
    pivots = stored(spark, pivots.filter("lo < hi").select("key", "pivot"), "pivots")
    met = members.drop("rank").join(pivots, "key").filter("id != pivot.id")
    met = met.select(
        F.struct("pivot.rank", "pivot.id").alias("pivot"),
        "id",
        *(F.col(f"pivot.{c}").alias(c + "1") for c in facts),
        *(F.col(c).alias(c + "2") for c in facts),
    )
    chosen = met.filter(fits("1", "2")).groupBy("id").agg(F.min("pivot").alias("pivot"))
    first = chosen.select(F.col("pivot.id").alias("a"), F.col("id").alias("b"))
    first = stored(spark, first, "first-pairs")
    links = stored(spark, compare(first), "first-links")
    release(pivots)
    roots = connected(spark, links)

    placed = members.join(roots, "id", "left")
    placed = stored(spark, placed.withColumn("root", F.coalesce("root", "id")), "placed")
    main = (
        placed.groupBy("key", "root")
        .agg(F.count("*").alias("members"))
        .groupBy("key")
        .agg(F.max(F.struct("members", "root")).getField("root").alias("main"), F.count("*").alias("roots"))
    )
    main = stored(spark, main.filter("roots > 1").drop("roots"), "main-roots")
    release(members)
    group = "main" if joint else "key"
    open_ = placed.drop("rank").join(main, "key")
    if joint:
        open_ = open_.drop("key").distinct()
    if profiles is not None:
        open_ = stored(spark, open_, "open-ids").join(profiles, "id")
    open_ = stored(spark, open_, "open-members")
    release(placed, main)
    apart = open_.filter(F.col("root") != F.col("main"))
    apart = stored(spark, apart, "apart-members") if joint else apart

    def named(df: DataFrame, end: str) -> DataFrame:
        return df.select(group, *(F.col(c).alias(c + end) for c in df.columns if c != group))

    both = named(apart, "1").join(named(open_, "2") if joint else named(open_, "2").withColumnRenamed("main2", "main"), group)
    again = (
        both.filter(F.col("root1") != F.col("root2"))
        .filter((F.col("root2") == F.col("main")) | (F.col("id1") < F.col("id2")))
        .filter(fits("1", "2") if agree is None else fits("1", "2") & agree("1", "2"))
        .select(
            F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"),
            F.least("root1", "root2").alias("root_a"), F.greatest("root1", "root2").alias("root_b"),
        )
    )
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    held = 1 if joint else max(LEAST_PAIRS, ROUND_PAIRS * open_.select("id").distinct().count())
    rounds = 1 if joint else max(1, ceil(again.count() / held))
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(rounds))

    def parted(pairs: DataFrame) -> DataFrame:
        """The pairs whose components are apart by now, with these."""
        placed = pairs.select("a", "b").join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
        root_a, root_b = F.coalesce("root_a", "a"), F.coalesce("root_b", "b")
        placed = placed.select("a", "b", F.least(root_a, root_b).alias("root_a"), F.greatest(root_a, root_b).alias("root_b"))
        return placed.filter("root_a <> root_b")

    for i in range(rounds):
        further = again.filter(turn == i).distinct().join(tried, ["a", "b"], "left_anti")
        further = stored(spark, parted(further) if i else further, "further-pairs")
        if i == rounds - 1:
            release(open_, apart)
        one = further.groupBy("root_a", "root_b").agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.*")
        one = stored(spark, one, "component-pairs")
        links, old = stored(spark, links.select("a", "b").union(compare(one).select("a", "b")), "links"), links
        release(old)
        roots, old = connected(spark, links), roots
        release(old)
        left = stored(spark, parted(further).select("a", "b").join(one, ["a", "b"], "left_anti"), "last-pairs")
        release(further, one)
        links, old = stored(spark, links.union(compare(left).select("a", "b")), "links"), links
        release(old, left)
        roots, old = connected(spark, links), roots
        release(old)
    return roots
