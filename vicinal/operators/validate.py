"""Data checks. One aggregate pass yields a table of violations; ``require`` turns it into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_NAMES = 10


def has_missing(v: Column) -> Column:
    return v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x))


def has_infinite(v: Column) -> Column:
    return F.coalesce(F.exists(v, lambda x: F.abs(x) == F.lit(float("inf"))), F.lit(False))


def finite(v: Column, what: str = "features") -> Column:
    """``v`` itself; a null array, or a null, NaN or infinite value in it, stops the job that reads it."""
    bad = has_missing(v) | has_infinite(v)
    return F.when(bad, F.raise_error(F.lit(f"null, NaN or infinite value in {what}"))).otherwise(v)


def row_checks(
    n_features: int,
    features: str = "features",
    label: str = "label",
    text: str | None = None,
) -> dict[str, Column]:
    """Predicates that are true for an offending row."""
    v = F.col(features)
    checks = {
        "missing_value": has_missing(v),
        "infinite_value": has_infinite(v),
        "wrong_length": F.coalesce(F.size(v) != n_features, F.lit(True)),
        "missing_label": F.col(label).isNull(),
        "label_not_binary": F.coalesce(~F.col(label).isin(0, 1), F.lit(False)),
    }
    if text is not None:
        checks["blank_text"] = F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
    return checks


WHOLE_TABLE = (("empty_table", "rows"), ("class_0_absent", "zeros"), ("class_1_absent", "ones"))


def check_totals(
    n_features: int, *, id_col: str = "sample_id", features: str = "features", label: str = "label", text: str | None = None, mark: str = ""
) -> list[Column]:
    """Aggregates that count every violation and find the smallest offending id. Names begin with ``mark``."""
    totals: list[Column] = []
    for name, bad in row_checks(n_features, features, label, text).items():
        totals += [F.count_if(bad).alias(f"{mark}n_{name}"), F.min(F.when(bad, F.col(id_col))).alias(f"{mark}s_{name}")]
    ones, zeros = (F.count_if(F.col(label) == c).alias(f"{mark}{n}") for c, n in ((1, "ones"), (0, "zeros")))
    return [*totals, F.count(F.lit(1)).alias(f"{mark}rows"), zeros, ones]


def found_violations(totals: dict, mark: str = "") -> list[tuple[str, int, str | None]]:
    """(check, n, sample) of the checks that found something, from the values of ``check_totals``."""
    begin = f"{mark}n_"
    found = [(k.removeprefix(begin), v, str(totals[f"{mark}s_{k.removeprefix(begin)}"])) for k, v in totals.items() if k.startswith(begin) and v]
    return found + [(check, 1, None) for check, count in WHOLE_TABLE if not totals[f"{mark}{count}"]]


def validation_report(
    df: DataFrame,
    n_features: int,
    *,
    id_col: str = "sample_id",
    features: str = "features",
    label: str = "label",
    text: str | None = None,
) -> DataFrame:
    """(check, n, sample): offending rows per check and the smallest offending id.

    The two class checks and the emptiness check count one violation for the table as a whole.
    """
    totals = df.agg(*check_totals(n_features, id_col=id_col, features=features, label=label, text=text))
    entries = [
        F.struct(F.lit(name).alias("check"), F.col(f"n_{name}").alias("n"), F.col(f"s_{name}").cast("string").alias("sample"))
        for name in row_checks(n_features, features, label, text)
    ]
    for name, count in WHOLE_TABLE:
        missing = F.when(F.col(count) == 0, F.lit(1)).otherwise(0).cast("bigint")
        entries.append(F.struct(F.lit(name).alias("check"), missing.alias("n"), F.lit(None).cast("string").alias("sample")))
    return totals.select(F.explode_outer(F.array(*entries)).alias("e")).select("e.*")


def refuse(violations: list[tuple[str, int, str | None]]) -> None:
    if violations:
        raise ValueError("; ".join(f"{check}: {n} (first: {sample})" for check, n, sample in violations))


def require(report: DataFrame) -> None:
    """Raise if any check found something. The report has one row per check."""
    refuse([(r["check"], r["n"], r["sample"]) for r in report.filter(F.col("n") > 0).collect()])


def require_two_classes(df: DataFrame, label: str = "label") -> None:
    row = df.agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")).first()
    if not row["a"] or not row["b"]:
        raise ValueError("both classes 0 and 1 must be present")


def cast_report(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """(feature, n_bad, first_bad): values of text columns that are not numbers."""
    cells = F.explode_outer(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("raw")) for c in columns]))
    long = df.select(F.col(id_col), cells.alias("c")).select(id_col, "c.*")
    bad = F.col("raw").isNotNull() & F.expr("try_cast(raw AS DOUBLE)").isNull()
    return (
        long.groupBy("feature")
        .agg(F.count_if(bad).alias("n_bad"), F.min(F.when(bad, F.col("raw"))).alias("first_bad"))
        .filter(F.col("n_bad") > 0)
    )


def duplicate_names(header: DataFrame) -> DataFrame:
    """``header`` is (pos, name). Names used more than once."""
    return header.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positions at which two headers (pos, name) differ."""
    a = left.select("pos", F.col("name").alias("left_name"))
    b = right.select("pos", F.col("name").alias("right_name"))
    return a.join(b, "pos", "full_outer").filter(~F.col("left_name").eqNullSafe(F.col("right_name")))


def missing_features(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required (pos, name) that are not present."""
    return required.join(present.select("name"), "name", "left_anti").select("pos", "name")


def require_features(required: Sequence[str], present: Sequence[str]) -> None:
    have = set(present)
    missing = [name for name in required if name not in have]
    if missing:
        raise ValueError(f"{len(missing)} missing features: {missing[:SAMPLE_NAMES]}")
