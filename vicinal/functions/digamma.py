"""Digamma of positive numbers as a plain expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 6


def digamma(x: Column) -> Column:
    """Recurrence up to x + 6, then the asymptotic series; error below 1e-10 for x >= 1."""
    value = x.cast("double")
    shifted = value + float(_SHIFT)
    inv2 = 1.0 / (shifted * shifted)
    series = inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    result = F.log(shifted) - 0.5 / shifted - series
    for step in range(_SHIFT):
        result = result - 1.0 / (value + float(step))
    return result


def digamma_sql(x: str) -> str:
    """The same expression as SQL text."""
    y = f"({x} + {float(_SHIFT)})"
    i = f"(1.0/({y}*{y}))"
    series = f"{i}*(1.0/12 - {i}*(1.0/120 - {i}*(1.0/252 - {i}*(1.0/240 - {i}/132))))"
    steps = "".join(f" - 1.0/({x} + {float(s)})" for s in range(_SHIFT))
    return f"(ln({y}) - 0.5/{y} - {series}{steps})"
