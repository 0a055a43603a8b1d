"""Vector expressions on ``array<float>`` columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from askloom.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product; NULL when the widths differ or an element is NULL."""
    products = F.zip_with(
        col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(v: Column | str) -> Column:
    def add_square(s: Column, x: Column) -> Column:
        return s + x.cast("double") * x.cast("double")

    return F.sqrt(F.aggregate(col(v), F.lit(0.0), add_square))


def cosine(
    a: Column | str,
    b: Column | str,
    norm_a: Column | None = None,
    norm_b: Column | None = None,
) -> Column:
    """Cosine similarity; zero and non-finite vectors give NULL. Stored norms may be passed in."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    return F.nullif(F.try_divide(dot(a, b), na * nb), F.lit(float("nan")))


def profile(v: Column | str) -> list[Column]:
    """Type name, width and first five values of a vector."""
    return [
        F.typeof(col(v)).alias("type_name"),
        F.size(col(v)).alias("width"),
        F.slice(col(v), 1, 5).alias("first_values"),
    ]


def has_width(v: Column | str, width: int) -> Column:
    """True only for a non-NULL vector of ``width`` finite elements."""
    sized = F.coalesce(F.size(col(v)) == width, F.lit(False))

    def unfit(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return sized & ~F.exists(F.coalesce(col(v), F.array()), unfit)
