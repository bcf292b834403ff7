"""Label normalisation, label checks and display names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.config import CLASS_NAMES

MOST_CLASSES = 1000

# Accepted label spellings, compared after trimming and lower-casing.
LABEL_WORDS = {
    "0": 0,
    "goodware": 0,
    "benign": 0,
    "safe": 0,
    "clean": 0,
    "false": 0,
    "1": 1,
    "malware": 1,
    "malicious": 1,
    "threat": 1,
    "true": 1,
}


def label_from_text(raw: Column) -> Column:
    """0, 1 or null for a spelling that is not known."""
    words = F.create_map(*[F.lit(x) for x in chain.from_iterable(LABEL_WORDS.items())])
    return F.try_element_at(words, F.lower(F.trim(raw.cast("string"))))


def label_from_number(raw: Column, strict: bool = True) -> Column:
    """Integral numbers only; ``strict=False`` truncates fractions instead of refusing them."""
    whole = raw.cast("bigint").cast("int")
    if not strict:
        return whole
    return F.when(raw.cast("double") == F.floor(raw.cast("double")), whole)


def normalise_labels(df: DataFrame, raw: str, out: str = "label", strict: bool = True) -> DataFrame:
    """Add ``out``; it is null where the raw value is null or not a label."""
    kind = df.schema[raw].dataType.typeName()
    if kind == "boolean":
        value = F.col(raw).cast("int")
    elif kind == "string":
        value = label_from_text(F.col(raw))
    else:
        value = label_from_number(F.col(raw), strict)
    return df.withColumn(out, value)


def invalid_labels(df: DataFrame, raw: str) -> DataFrame:
    """Distinct unknown spellings with their counts."""
    checked = normalise_labels(df, raw, "__label")
    return (
        checked.filter(F.col("__label").isNull() & F.col(raw).isNotNull())
        .groupBy(F.col(raw).cast("string").alias("raw_label"))
        .agg(F.count("*").alias("n"))
    )


def class_sizes(df: DataFrame, label: str = "label") -> dict:
    """Rows per class, in the driver. A column that is no class label is refused rather than collected."""
    rows = df.groupBy(label).count().limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"column {label!r} has more than {MOST_CLASSES} values and is no class label")
    return {r[0]: r[1] for r in rows}


def label_name(label: Column) -> Column:
    result = None
    for value, name in CLASS_NAMES.items():
        result = F.when(label == value, name) if result is None else result.when(label == value, name)
    return result


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(label)
