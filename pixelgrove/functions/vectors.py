"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float | None = None) -> Column:
    """Vector of length one. A zero vector stays as it is, or with ``floor`` is divided by that."""
    n = norm(a)
    by = F.greatest(n, F.lit(floor)) if floor is not None else F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(doubles(a), lambda x: x / by)


def cosine(a: Column, b: Column, epsilon: float = 1e-10) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + epsilon)


def scaled(cos: Column, scale: str) -> Column:
    """A cosine as the store reports it ('os': 0 to 1), or as it is ('cos')."""
    if scale not in ("os", "cos"):
        raise ValueError(scale)
    return (cos + 1) / 2 if scale == "os" else cos


def valid_norm(a: Column, low: float = 0.9, high: float = 1.1) -> Column:
    return norm(a).between(low, high)
