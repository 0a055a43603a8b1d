"""Text expressions: strip, newline folding, previews, chunk arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from askloom import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends; plain ``trim`` only knows the blank."""
    return F.btrim(col(c), F.lit(fixed.WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return F.length(strip(c)) == 0


def fold_newlines(c: Column | str) -> Column:
    """Turn CRLF and lone CR into LF, as a text-mode file read does."""
    return F.regexp_replace(col(c), "\r\n?", "\n")


def preview(c: Column | str, n: int = fixed.PREVIEW_CHARS) -> Column:
    """First ``n`` code points followed by dots, whatever the text length."""
    return F.concat(F.left(col(c), F.lit(n)), F.lit(fixed.PREVIEW_END))


def clip(c: Column | str, n: int = fixed.RESULT_CHARS) -> Column:
    return F.left(col(c), F.lit(n))


def literal_pattern(text: str) -> str:
    """Quote ``text`` for ``split``, which takes a regular expression."""
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in text)


def paragraphs(c: Column | str, delimiter: str = fixed.PARAGRAPH_DELIMITER) -> Column:
    """Array of stripped, non-blank pieces of a text.

    A piece that starts with the heading mark before stripping is dropped. Headings
    become empty strings so that each piece is stripped once and one
    ``array_remove`` drops both kinds.
    """
    pieces = F.split(col(c), literal_pattern(delimiter), -1)
    stripped = F.transform(
        pieces,
        lambda p: F.when(p.startswith(fixed.HEADING_MARK), F.lit("")).otherwise(strip(p)),
    )
    return F.array_remove(stripped, "")
