"""Helpers shared by the text operators: row keys, attaching decisions to rows, walking Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "__fp"


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, __fp): null text as empty. ``__fp`` tells rows apart that share an id but not a text.

    The key depends on the row alone, so a task that is run again gives the same keys.
    """
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias(KEY))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a[KEY] == b[KEY])


def attach(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All rows of ``docs`` with the columns of ``decisions`` (id, __fp, ...), which has one row per key.

    A column of ``docs`` that carries the name of a decision is replaced by the decision.
    """
    names = [c for c in decisions.columns if c not in ("id", KEY)]
    right = decisions.select(F.col("id").alias("__did"), F.col(KEY).alias("__dfp"), *[F.col(c).alias(f"__d_{c}") for c in names])
    left = docs.drop(*[c for c in names if c not in (id_col, text_col)])
    kept = left.columns
    left = left.withColumn(KEY, F.xxhash64(text_of(text_col)))
    joined = left.join(right, left[id_col].eqNullSafe(right["__did"]) & (left[KEY] == right["__dfp"]), "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"__d_{c}").alias(c) for c in names])


def single_rows(docs: DataFrame, id_col: str, repeats: str, text_col: str = "text") -> DataFrame:
    """Rows whose ``repeats`` is over 1 stand several times under one id and text; one of them is returned.

    Only those rows are shuffled.
    """
    once = docs.where(F.col(repeats) <= 1)
    again = docs.where(F.col(repeats) > 1).withColumn(KEY, F.xxhash64(text_of(text_col))).dropDuplicates([id_col, KEY])
    return once.unionByName(again.drop(KEY)).drop(repeats)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a piece stay near ``most_bytes``; a longer text is a piece of its own."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        begin = held = 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)
