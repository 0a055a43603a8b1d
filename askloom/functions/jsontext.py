"""JSON text judged by ``json.loads``.

Spark's JSON readers accept text after the first value, and its variant type rejects
repeated keys and merges ``1`` with ``1.0``; logged lines and call arguments need the
stricter reading. For reply lines one Arrow-batched ``json.loads`` each was measured to
be as fast as native plans that guard against these cases, so it is used alone. Call
arguments are mostly simple enough for the JVM, which was four times as fast.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from askloom.functions.text import col


def _clean(text: str) -> str:
    """Replace lone surrogates, which no Arrow string can hold."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def mapped(c: Column | str, make_read: Callable[[], Callable[[object], str | None]]) -> Column:
    """Apply a reader to each parsed value. Text that is not JSON gives NULL.

    The reader may raise the lookup errors of a value of another shape; they give NULL
    too. ``make_read`` builds it once per batch.
    """

    def over(texts: pa.Array) -> pa.Array:
        read = make_read()

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                result = read(json.loads(text))
            except (ValueError, LookupError, TypeError, AttributeError, RecursionError):
                return None
            return result if result is None or result.isascii() else _clean(result)

        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(over, T.StringType())(col(c))


# A flat object of plain ASCII strings without escapes, integers of up to 18 digits,
# true, false and null: for these the variant type prints what the encoder below prints.
# Every repetition is possessive, so matching neither recurses nor backtracks.
_STRING = r'"[ !#-\[\]-~]*+"'
_VALUE = rf"(?:{_STRING}|-?+[1-9][0-9]{{0,17}}+|0|true|false|null)"
_FLAT = rf'\A\{{\s*+(?:{_STRING}\s*+:\s*+{_VALUE}\s*+(?:,\s*+(?=")|(?=\}})))*+\}}\z'


def canonical_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: compact JSON with sorted keys, NULL where ``text`` is not JSON.

    ``1`` and ``1.0`` differ and the last of several equal keys wins. Simple arguments
    stay on the JVM; the function sees NULL for them.
    """

    def make_print() -> Callable[[object], str]:
        return json.JSONEncoder(
            sort_keys=True, separators=(",", ":"), ensure_ascii=False, check_circular=False
        ).encode

    native = F.when(F.col(text).rlike(_FLAT), F.to_json(F.try_parse_json(text)))
    marked = df.withColumn("__native", native)
    other = mapped(F.when(F.col("__native").isNull(), F.col(text)), make_print)
    return marked.withColumn(out, F.coalesce("__native", other)).drop("__native")


def token_text(value: object) -> str:
    """A token as text; a JSON null is an empty token."""
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value)
