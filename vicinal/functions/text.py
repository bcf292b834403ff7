"""Text forms of a row: number formatting, feature statements, chunks and display vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vicinal.functions.vectors import as_float, let

# The wording of the text form of a row.
STATEMENT_FORMAT = "%s has standardized value %s"
STATEMENT_SEPARATOR = "; "
CHUNK_PREFIX = "Windows PE static features. "
CHUNK_END = "."


def even_ties(x: Column, digits: int) -> Column:
    """Move exact decimal ties to the even neighbour, as IEEE formatting does.

    The JVM formatter rounds ties away from zero. A binary number can only be an exact tie if twice
    its scaled value is an odd integer, so only those values are rounded beforehand.
    """
    value = x.cast("double")
    doubled = value * F.lit(float(2 * 10**digits))
    is_tie = (doubled == F.rint(doubled)) & (F.abs(doubled) % 2 == 1)
    return F.when(is_tie, F.bround(value, digits)).otherwise(value)


def fixed(x: Column, digits: int, signed: bool = False) -> Column:
    """``x`` with a fixed number of decimals, the sign always shown if ``signed``."""
    sign = "+" if signed else ""
    return F.format_string(f"%{sign}.{digits}f", even_ties(x, digits))


def top_abs(values: Column, n: int) -> Column:
    """The ``n`` entries of largest absolute value as (pos, value), in position order.

    Ties go to the smaller position. Only the plain numbers are sorted, to find the n-th largest size;
    the entries are then filtered in place.
    """
    typed = as_float(values)
    entries = F.transform(typed, lambda v, p: F.struct(p.alias("pos"), v.alias("value")))
    sizes = F.transform(typed, lambda v: F.coalesce(F.abs(v), F.lit(0.0).cast("float")))

    def choose(a: Column) -> Column:
        return let(F.get(F.sort_array(a), F.size(a) - n), lambda least: cut(a, least))

    def cut(a: Column, least: Column) -> Column:
        room = n - F.size(F.filter(a, lambda x: x > least))
        ties = F.filter(F.transform(a, lambda x, p: F.when(x == least, p).otherwise(-1)), lambda p: p >= 0)
        return let(
            F.get(ties, room - 1),
            lambda last: F.filter(
                entries,
                lambda e: (F.abs(e["value"]) > least) | ((F.abs(e["value"]) == least) & (e["pos"] <= last)),
            ),
        )

    return F.when(F.size(values) <= n, entries).otherwise(let(sizes, choose))


def feature_statements(selected: Column, names: Column) -> Column:
    """One sentence part per selected (pos, value); ``names`` is the array of all feature names."""
    return let(
        names,
        lambda all_names: F.transform(
            selected,
            lambda s: F.format_string(
                STATEMENT_FORMAT,
                F.element_at(all_names, s["pos"] + 1),
                fixed(s["value"], 4, signed=True),
            ),
        ),
    )


def text_chunks(statements: Column, per_chunk: int, prefix: str = CHUNK_PREFIX) -> Column:
    """Consecutive groups of ``per_chunk`` statements as sentences."""
    return let(
        statements,
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts), F.lit(per_chunk)),
            lambda start: F.concat(
                F.lit(prefix),
                F.array_join(F.slice(parts, start, per_chunk), STATEMENT_SEPARATOR),
                F.lit(CHUNK_END),
            ),
        ),
    )


def display_items(values: Column, labels: list[str], limit: int) -> Column:
    """The first ``limit`` features as ``name (description)=value`` strings, in list order."""
    shown = labels[: max(0, limit)]
    return F.zip_with(
        F.slice(as_float(values), 1, len(shown)),
        F.slice(F.lit(shown), 1, F.least(F.size(values), F.lit(len(shown)))),
        lambda v, label: F.concat(label, F.lit("="), fixed(v, 3, signed=True)),
    )


def display_labels(names: list[str], descriptions: dict[str, str]) -> list[str]:
    """``name (description)``; a name without a description describes itself."""
    return [f"{name} ({descriptions.get(name, name)})" for name in names]


def token_count(text: Column) -> Column:
    """Default token counter: words and single punctuation marks."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(\w+|[^\w\s])"), F.lit(1)))
