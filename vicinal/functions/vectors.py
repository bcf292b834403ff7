"""Vector arithmetic on array columns. Everything stays in JVM expressions and adds up in DOUBLE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``.

    A lambda body is evaluated per element, so an outer array used inside it would be recomputed for
    every element. Wrapping it into a one-element array turns it into a bound variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def as_float(v: Column) -> Column:
    return v.cast("array<float>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def mean_abs_distance(a: Column, b: Column) -> Column:
    total = _total(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))
    return total / F.size(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector scores 0 against everything."""
    scale = norm(a) * norm(b)
    return F.coalesce(dot(a, b) / F.nullif(scale, F.lit(0.0)), F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector is left as it is."""
    return F.zip_with(
        as_double(v),
        F.array_repeat(norm(v), F.size(v)),
        lambda x, n: F.when(n > 0, x / n).otherwise(x),
    )


def pick_positions(v: Column, positions: list[int]) -> Column:
    """Project and reorder an array by 0-based positions."""
    return let(v, lambda a: F.transform(F.lit(positions), lambda p: F.element_at(a, p + F.lit(1))))
