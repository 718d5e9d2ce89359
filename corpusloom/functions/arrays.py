"""Array and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """``v`` at length one; a zero vector stays."""
    return F.transform(v, lambda x: F.when(norm(v) > 0, x.cast("double") / norm(v)).otherwise(0.0))


def entropy(p: Column) -> Column:
    """Shannon entropy in nats; zero entries count nothing."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x.cast("double") * F.log(x.cast("double"))).otherwise(0.0))


def first_n(v: Column, n: int) -> Column:
    """The first n entries."""
    return F.slice(v, 1, n)


def last_n(v: Column, n: int) -> Column:
    """The last n entries."""
    return F.slice(v, F.greatest(F.size(v) - n + 1, F.lit(1)), n)


def without_trailing(v: Column, value: int) -> Column:
    """``v`` without its last entry if that is ``value``."""
    return F.when((F.size(v) > 0) & (F.try_element_at(v, F.lit(-1)) == value), F.slice(v, 1, F.size(v) - 1)).otherwise(v)


def aligned(signal: Column, tokens: Column) -> Column:
    """A per-label signal if it has an entry for every token but the first, else null."""
    return F.when(F.size(signal) == F.size(tokens) - 1, signal)
