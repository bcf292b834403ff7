"""Wide labelled CSV files: read, check, pack into one array column, rename, write."""

from __future__ import annotations

import csv
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.operators.features import select_features
from vicinal.operators.labels import normalise_labels
from vicinal.operators.sample import sample_rows
from vicinal.operators.validate import check_totals, found_violations, refuse, require_two_classes
from vicinal.session import stored

LABEL_COLUMN = "label"


@dataclass(frozen=True)
class LabelledTable:
    """Rows (sample_id, features, label) and the feature names in array order."""

    rows: DataFrame
    names: list[str]


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names as written. Read here because the CSV reader renames duplicates."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"empty dataset: {path}")
    return next(csv.reader([first[0]]))


def check_header(header: list[str], target: str | None, id_column: str | None = None) -> str:
    """Name of the label column; raises for too few columns, duplicates or an absent label."""
    if len(header) < 2:
        raise ValueError("a dataset needs at least two columns")
    target = target or header[-1]
    if target not in header:
        raise ValueError(f"target column {target!r} not found")
    if id_column is not None and id_column not in header:
        raise ValueError(f"id column {id_column!r} not found")
    repeated = sorted(name for name, n in Counter(header).items() if n > 1)
    if repeated:
        raise ValueError(f"duplicate feature names: {repeated[:10]}")
    return target


def pack(df: DataFrame, names: list[str], target: str, id_column: str | None) -> DataFrame:
    """(sample_id, features, raw_label). Packing right after the scan keeps later plans narrow."""
    row_id = F.monotonically_increasing_id() if id_column is None else F.col(f"`{id_column}`").cast("bigint")
    values = F.array(*[F.col(f"`{n}`").try_cast("double") for n in names])
    return df.select(row_id.alias("sample_id"), values.alias("features"), F.col(f"`{target}`").alias("raw_label"))


@dataclass(frozen=True)
class _Parsed:
    """(sample_id, features, as_number, as_word, word): the label read both ways, and whether it is no number."""

    rows: DataFrame
    names: list[str]


def _parse(spark: SparkSession, path: str, target: str | None, id_column: str | None) -> _Parsed:
    header = csv_header(spark, path)
    target = check_header(header, target, id_column)
    names = [c for c in header if c not in (target, id_column)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.option("enforceSchema", "false").csv(path, header=True, schema=schema)
    packed = pack(raw, names, target, id_column).withColumn("number", F.col("raw_label").try_cast("double"))
    both = normalise_labels(normalise_labels(packed, "number", "as_number"), "raw_label", "as_word")
    word = (F.col("raw_label").isNotNull() & F.col("number").isNull()).alias("word")
    return _Parsed(both.select("sample_id", "features", "as_number", "as_word", word), names)


def _labelled(parsed: DataFrame, words: bool) -> DataFrame:
    return parsed.select("sample_id", "features", F.col("as_word" if words else "as_number").alias("label"))


def scan_csv(
    spark: SparkSession, path: str, target: str | None = None, id_column: str | None = None
) -> LabelledTable:
    """Labelled rows without checks of the values; what is not a number becomes null.

    Every file of a folder must have the same header in the same order; another one stops the job that reads it. A label
    column of numbers only is read as numbers, any other as words.
    """
    parsed = _parse(spark, path, target, id_column)
    return LabelledTable(_labelled(parsed.rows, not parsed.rows.where("word").isEmpty()), parsed.names)


def same_names(left: LabelledTable, right: LabelledTable) -> LabelledTable:
    """``right`` with the features of ``left`` in its order; raises if one is missing."""
    return LabelledTable(select_features(right.rows, right.names, left.names), left.names)


def load_csv(
    spark: SparkSession,
    path: str,
    target: str | None = None,
    limit: int | None = None,
    seed: int = 42,
    balanced: bool = False,
    id_column: str | None = None,
) -> LabelledTable:
    """Parse once into a stored table, refuse anything missing, infinite or unlabelled, sample.

    The job that parses and writes also counts all violations, for either way to read the label, and whether there is a label that
    is no number; nothing is read again to be checked. Storing also fixes the generated row ids for good.
    """
    data = _parse(spark, path, target, id_column)
    watch = Observation()
    checks = [c for way in ("as_number", "as_word") for c in check_totals(len(data.names), label=way, mark=f"{way}_")]
    kept = stored(data.rows.observe(watch, F.count_if("word").alias("words"), *checks), "labelled")
    words = watch.get["words"] > 0
    refuse(found_violations(watch.get, "as_word_" if words else "as_number_"))
    parsed = _labelled(kept, words)
    rows = sample_rows(parsed, limit, seed, balanced)
    if rows is not parsed:
        require_two_classes(rows)
    return LabelledTable(rows, data.names)


def rename_positional(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace all headers but the last by the first names of a dictionary; the last becomes the label."""
    width = len(df.columns) - 1
    if width > len(names):
        raise ValueError(f"{width} feature columns but only {len(names)} names")
    return df.toDF(*names[:width], LABEL_COLUMN)


def unpack(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Array column back to one column per feature."""
    return df.select(*keep, *[F.col("features")[i].alias(n) for i, n in enumerate(names)], LABEL_COLUMN)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
