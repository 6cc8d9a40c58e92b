"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Scaled to length one; null where it has none."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def is_sound(a: Column, size: int, tolerance: float = 1e-3) -> Column:
    """Of the right size, finite and of length one."""
    finite = ~F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(a) == size) & finite & (F.abs(norm(a) - 1) <= tolerance)
