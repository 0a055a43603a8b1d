"""Exact copies of texts: groups of equal content hashes, kept apart if their bytes differ.

Texts are equal if they are after each run of ASCII white space has become one space. Rows
are grouped by a 128-bit hash of that. Within a hash that several rows share, the texts
themselves are the grouping key once more, so that their bytes are compared: each task
first reduces its copies to one row, hence a group that holds a third of all rows sends one
text per task. Texts of hashes that occur once never leave their task where the list of
shared hashes is small enough to be broadcast, else they are shuffled once. Only hashes
that hold different texts, which a 128-bit hash of honest data never has, are grouped by
text further on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askloom.llm.stored import stored
from askloom.plans.sizing import broadcast_if_small

# Fixed value: the white space that is made equal, ASCII only.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SHARED_BYTES = 64 << 20  # shared hashes that go to every task


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ")


def _grouped(spark: SparkSession, rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their group's kept row and size; the long side's hot keys can be split."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at"))
    groups = rows.groupBy(*by).agg(F.count("*").alias("group_size"), first.alias("first"))
    several = groups.filter("group_size > 1").select(*by, "group_size", "first.doc_id", "first.at")
    several = stored(spark, several.toDF(*by, "group_size", "keep_id", "keep_at"), "copy-groups")
    alone = F.col("group_size").isNull()
    return rows.join(several, by, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("at") == F.col("keep_at"))).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def find_copies(
    spark: SparkSession, docs: DataFrame, *, content: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Of equal texts the row with the least ``doc_id`` is kept; if rows repeat that id too, one
    of them is. A null ``doc_id`` comes after all others and stays null; a null text
    counts as empty, so null and empty texts are one group, and texts of white space alone
    another; an empty table gives no rows; other columns are ignored. ``content`` makes the
    hash to group by, of any type; results don't depend on it.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        content(normalised(F.col("text"))).alias("key"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha256"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = stored(spark, rows, "content-hashes")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    shared = broadcast_if_small(stored(spark, shared, "shared-hashes"), SHARED_BYTES)
    text = normalised(F.col("text"))
    texts = docs.select(content(text).alias("key"), text.alias("text")).join(shared, "key", "left_semi")
    different = texts.groupBy("key", "text").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"))
    different = stored(spark, different.filter("n > 1").select("key"), "hashes-of-several-texts")
    if different.isEmpty():
        return _grouped(spark, rows, ["key"])
    apart = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        content(text).alias("key"),
        text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("sha256"),
        F.monotonically_increasing_id().alias("at"),
    )
    apart = stored(spark, apart.join(different, "key", "left_semi"), "texts-of-one-hash")
    plain = _grouped(spark, rows.join(different, "key", "left_anti"), ["key"])
    return plain.union(_grouped(spark, apart, ["key", "text"]))


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose id and text are those of a kept row.

    Rows that repeat both the id and the text stay as often as they occur.
    """
    kept = find_copies(spark, docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.sha2(normalised(F.col("text")), 256) == F.col("__sha"))
    return docs.join(kept.distinct(), same, "left_semi")
