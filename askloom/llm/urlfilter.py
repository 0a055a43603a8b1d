"""Block lists for pages, with decisions that follow redirects and canonical links.

A page's own rule decides first. Pages also name other addresses as themselves: by a
canonical link, by a redirect in their head, and by spellings of one address that differ
in scheme, ``www.`` or ``m.``, fragment, tracking parameters, a closing slash or ``.html``.
These equivalences form a graph; an address in a component with a blocked one is blocked
too, unless a rule allows the address itself or another one of the component.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askloom.llm.components import connected
from askloom.llm.stored import stored
from askloom.plans.skew import spread_join


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str


# The rules.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

_ATTRIBUTE = r"""\s*=\s*["']?\s*"""
CANONICAL = (
    rf"""(?i)<link\b(?=[^>]*\brel{_ATTRIBUTE}canonical\b)[^>]*\bhref{_ATTRIBUTE}([^"'\s>]+)"""
)
REFRESH = (
    rf"""(?i)<meta\b(?=[^>]*\bhttp-equiv{_ATTRIBUTE}refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*\burl\s*=\s*["']?([^"'\s>]+)"""
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """``struct(length, allows, rule)`` of the longest rule that fits, or null.

    Of two rules with one text the one that allows wins. ``rules`` is a list of the
    caller's and part of the plan; it does not grow with the pages.
    """
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(
                F.lit(len(r.host + r.path)).alias("length"),
                F.lit(r.verdict == "allow").alias("allows"),
                F.lit(r.host + r.path).alias("rule"),
            ),
        )
        for r in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def address(url: Column) -> Column:
    """The spelling that stands for a url and its usual variants; null without a host."""
    host = F.regexp_replace(host_of(url), r"\A(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/|\.html?)\z", "")
    query = F.regexp_extract(_rest(url), r"\A[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(r"\A(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|\z)"))
    )
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, asked))


def without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments resolved."""
    ended = F.concat(path, F.when(path.rlike(r"/\.\.?\z"), "/").otherwise(""))
    steps = F.filter(F.split(ended, "/", -1), lambda x, i: (i > 0) & (x != "."))
    left = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda seen, x: F.when(x == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(
            F.concat(seen, F.array(x))
        ),
    )
    return F.concat(F.lit("/"), F.array_join(left, "/"))


def absolute(link: Column, url: Column) -> Column:
    """A link as a url, a relative one resolved against the page's; null if it is no web address.

    Only links that begin with a scheme are whole: a ``://`` later on is part of a query.
    ``base`` tags are not read.
    """
    scheme = F.regexp_extract(url, r"\A([^:/?#]+)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    path, tail = F.regexp_extract(link, r"\A[^?#]*", 0), F.regexp_extract(link, r"\A[^?#]*([\s\S]*)", 1)
    own = F.concat(F.when(path_of(url).startswith("/"), "").otherwise("/"), path_of(url))
    folder = F.regexp_extract(own, r"\A[\s\S]*/", 0)
    return (
        F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(host_of(url) == "", F.lit(None))
        .when(link.startswith("#"), url)
        .when(link.startswith("?"), F.concat(root, own, link))
        .when(link.startswith("/"), F.concat(root, without_dots(path), tail))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), tail))
    )


def filter_urls(spark: SparkSession, pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, address`` for every row.

    A null url, or one without ``://``, has empty host and path, fits no rule, has no
    aliases and is allowed; a null ``html`` has no links; repeated rows are judged each and
    equal urls alike; an empty table gives no rows; other columns are ignored.
    """
    url, html = F.col("url"), F.col("html")
    links = F.array_distinct(
        F.concat(*(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(p), 1) for p in (CANONICAL, REFRESH)))
    )
    seen = pages.select(F.col("page_id"), url.cast("string").alias("url"), html.cast("string").alias("html"))
    judged = (
        seen.withColumn("host", host_of(url))
        .withColumn("path", path_of(url))
        .withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", "fit", address(url).alias("address"), F.transform(links, lambda x: absolute(x, url)).alias("links"))
    )
    judged = stored(spark, judged, "judged-pages")

    linked = judged.filter(F.size("links") > 0).select("address", F.explode("links").alias("link"))
    linked = linked.select("address", "link", address(F.col("link")).alias("target"))
    named = linked.filter(F.col("link").isNotNull()).select(
        F.col("target").alias("address"),
        fitting_rule(host_of(F.col("link")), path_of(F.col("link")), rules).alias("fit"),
    )
    told = judged.select("address", "fit").union(named)
    told = told.filter(F.col("address").isNotNull() & F.col("fit").isNotNull())
    told = told.groupBy("address").agg(
        F.max(F.col("fit.allows")).alias("allows"), F.max(~F.col("fit.allows")).alias("blocks")
    )
    joined = connected(spark, linked.select(F.col("address").alias("a"), F.col("target").alias("b")))
    joined = joined.withColumnRenamed("id", "address")
    decided = (
        told.join(joined, "address", "full")
        .withColumn("root", F.coalesce("root", "address"))
        .select("address", "root", "allows", "blocks")
    )
    decided = stored(spark, decided, "decided-addresses")
    by_root = decided.groupBy("root").agg(
        (F.max("blocks") & ~F.coalesce(F.max("allows"), F.lit(False))).alias("blocked")
    )
    by_address = spread_join(decided.select("address", "root"), by_root, "root")
    final = spread_join(judged, by_address.select("address", "blocked"), "address", "left")
    own = F.when(F.col("fit.allows"), "allow").when(~F.col("fit.allows"), "block")
    heard = F.when(F.col("blocked"), "block").otherwise("allow")
    return final.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(own, heard).alias("verdict"), "address"
    )
