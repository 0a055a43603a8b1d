"""Personal data in texts: fixed patterns, and identifiers found by their context.

All work is done by DataFrame functions. A pattern is matched as ``(gap)(match or end)``,
so that one pass gives the matches with what lies between them and offsets are running
sums of lengths. All parts that may repeat are possessive, and runs are only tried at
their beginning or where the last match ended, so matching takes linear time.

The fixed patterns' matches are seeds of a bootstrap. An occurrence has lexical patterns:
the two words before it, and the word before it with its shape. The words are those of the
text, other strings with digits among them; digits count as equal. Occurrences of seeds and
of other strings with many digits form a graph of patterns and instances. A pattern is
trusted if at least ``SUPPORT`` known instances occur in it and they are at least
``PRECISION`` of its instances, and then all of its instances become known; this goes on
until no pattern is added. Occurrences in a trusted pattern are reported besides the seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from askloom.llm.stored import release, stored
from askloom.plans.skew import spread_join

SUPPORT = 3
PRECISION = 0.5
MIN_DIGITS = 5
LAST_PIECES = 4  # two words, one that may be cut, and what stands at the occurrence itself

# The kinds in their order; "context" is what the bootstrap adds.
KINDS = ("email", "ip", "card", "phone", "context")

# The patterns, in possessive form.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9](?:[\x20().-]*+[0-9])++"
PART = r"[A-Za-z0-9@._+()-]"
CONTEXT = rf"(?<!{PART})[A-Za-z@._+()-]*+[0-9]{PART}*+"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether a string of digits has a correct check digit."""

    def weighed(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)

    each = F.transform(F.reverse(F.split(digits, "")), weighed)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def matches(text: Column) -> Column:
    """``array<struct<kind, list<struct<gap, before, hit>>>>`` for the kinds that may occur."""
    may = {
        "email": (EMAIL, text.contains("@")),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        "phone": (PHONE, text.contains("+")),
        "context": (CONTEXT, text.rlike("[0-9]")),
    }

    def found(pattern: str, occurs: Column) -> Column:
        whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
        both = F.arrays_zip(
            F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"),
            F.regexp_extract_all(text, whole, F.lit(2)).alias("hit"),
        )
        parts = F.transform(
            both,
            lambda x: F.struct(
                F.length(x["gap"]).cast("long").alias("gap"),
                F.substring_index(F.regexp_replace(x["gap"], r"\s++", " "), " ", -LAST_PIECES).alias("before"),
                x["hit"].alias("hit"),
            ),
        )
        return F.when(occurs, F.filter(parts, lambda x: x["hit"] != ""))

    return F.array(
        *(F.struct(F.lit(i).alias("kind"), found(*may[k]).alias("parts")) for i, k in enumerate(KINDS))
    )


def is_valid(kind: Column, hit: Column) -> Column:
    digits = _digits(hit)
    n = F.length(digits)
    parts = F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    return (
        F.when(kind == KINDS.index("ip"), parts)
        .when(kind == KINDS.index("card"), F.when(n.between(13, 19), passes_luhn(digits)).otherwise(False))
        .when(kind == KINDS.index("phone"), n.between(9, 15))
        .when(kind == KINDS.index("context"), n >= MIN_DIGITS)
        .otherwise(True)
    )


def lexical_patterns(before: Column, hit: Column) -> Column:
    """The patterns of an occurrence; none without a word before it."""
    before = F.regexp_replace(F.lower(before), "[0-9]+", "9")
    two = F.regexp_extract(before, r"(\S+\s+\S+)\s*\z", 1)
    one = F.regexp_extract(before, r"(\S+)\s*\z", 1)
    shape = F.regexp_replace(F.regexp_replace(hit, "[A-Za-z]+", "a"), "[0-9]+", "9")
    found = F.array(
        F.when(two != "", F.regexp_replace(two, r"\s+", " ")),
        F.when(one != "", F.concat(one, F.lit(" | "), shape)),
    )
    return F.array_compact(found)


def occurrences(texts: DataFrame) -> DataFrame:
    """``rid, key, kind, start, end, value, patterns`` of ``texts(key, text)``.

    ``rid`` tells rows apart. Failing matches are gone, and so are strings of the last kind
    that overlap a match of another.
    """
    rows = texts.withColumn("rid", F.monotonically_increasing_id())  # numbered before rows are multiplied
    rows = rows.select("rid", "key", F.explode(matches(F.col("text"))).alias("m"))
    rows = rows.select("rid", "key", F.col("m.kind").alias("kind"), F.posexplode("m.parts").alias("at", "part"))
    rows = rows.select("rid", "key", "kind", "at", "part.*").withColumn("size", F.length("hit").cast("long"))
    running = Window.partitionBy("rid", "kind").orderBy("at")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(running))
    in_order = Window.partitionBy("rid", "kind").orderBy("at")
    piece = F.concat("before", "hit")  # a match, failing ones too, is at least a word of the next one's context
    context = F.concat(F.lag(piece, 2, "").over(in_order), F.lag(piece, 1, "").over(in_order), "before")
    rows = rows.withColumn("before", context)
    rows = rows.filter(is_valid(F.col("kind"), F.col("hit"))).withColumn("start", F.col("end") - F.col("size"))
    is_base = F.col("kind") < KINDS.index("context")
    by_place = Window.partitionBy("rid").orderBy("start", "end", "kind")
    earlier = F.max(F.when(is_base, F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first(F.when(is_base, F.col("start")), ignorenulls=True).over(by_place.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"earlier": earlier, "later": later})
    apart = (F.coalesce(F.col("earlier"), F.lit(-1)) <= F.col("start")) & (
        F.coalesce(F.col("later"), F.col("end")) >= F.col("end")
    )
    return rows.filter(is_base | apart).select(
        "rid", "key", "kind", "start", "end",
        F.lower("hit").alias("value"),
        lexical_patterns(F.col("before"), F.col("hit")).alias("patterns"),
    )


def trusted_patterns(spark: SparkSession, found: DataFrame) -> DataFrame:
    """``pattern`` for all that become trusted over ``found``, a stored table.

    Known instances and trusted patterns only grow, so the rounds end; each one's tables are
    deleted when the next one's are written.
    """
    edges = stored(
        spark,
        found.select(F.explode("patterns").alias("pattern"), "value", (F.col("kind") < KINDS.index("context")).alias("seed"))
        .groupBy("pattern", "value")
        .agg(F.max("seed").alias("seed")),
        "pattern-instances",
    )
    known = stored(spark, edges.groupBy("value").agg(F.max("seed").alias("known")), "known-instances")
    trusted, n = None, 0
    while True:
        seen = spread_join(edges.select("pattern", "value"), known, "value")
        counts = seen.groupBy("pattern").agg(F.count_if("known").alias("known"), F.count("*").alias("all"))
        enough = (F.col("known") >= SUPPORT) & (F.col("known") >= PRECISION * F.col("all"))
        now = stored(spark, counts.filter(enough).select("pattern"), "trusted-patterns")
        if trusted is not None:
            release(trusted)
        trusted, before, n = now, n, now.count()
        if n == before:
            release(edges, known)
            return trusted
        reached = spread_join(edges.select("pattern", "value"), trusted, "pattern").select("value", F.lit(True).alias("known"))
        wider = known.union(reached).groupBy("value").agg(F.max("known").alias("known"))
        known, old = stored(spark, wider, "known-instances"), known
        release(old)


def find_personal(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data for every row.

    A null or empty text has none; a null ``doc_id`` stays null; repeated rows and equal
    texts get equal results; an empty table gives no rows; other columns are ignored.
    Offsets are code points, ends exclusive.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary"))).alias("key")
    found = stored(spark, occurrences(docs.select(key, text.alias("text"))), "occurrences")
    trusted = trusted_patterns(spark, found)

    last = KINDS.index("context")
    others = found.filter(F.col("kind") == last)
    hinted = others.select("rid", "start", F.explode("patterns").alias("pattern"))
    hinted = spread_join(stored(spark, hinted, "hinted"), trusted, "pattern").select("rid", "start").distinct()
    spans = found.filter(F.col("kind") < last).unionByName(others.join(hinted, ["rid", "start"], "left_semi"))

    def written(spans: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        each = F.transform(
            spans,
            lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")),
        )
        return F.array_join(each, ",")

    by_row = spans.groupBy("rid").agg(
        F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("all")
    )
    base = F.filter("all", lambda x: x["kind"] < last)

    def count_of(kind: int) -> Column:
        return F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long")

    counts = {f"n_{name}": count_of(i) for i, name in enumerate(KINDS)}
    by_row = by_row.withColumns(counts | {"base": written(base), "spans": written(F.col("all"))}).drop("all", "rid")
    names = [c for c in by_row.columns if c != "key"]
    by_text = stored(spark, by_row.groupBy("key").agg(*(F.first(c).alias(c) for c in names)), "spans-by-text")

    rows = stored(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), key), "keyed-rows")
    final = spread_join(rows, by_text, "key", "left")
    return final.select(
        "doc_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
