"""Counts of feature values beside a stored index: scores that follow what is appended.

All that mutual information needs of the rows is how often each class has each value of each feature. These counts of two sets
of rows add up, so a batch that is appended to an index is counted alone, and scores come from the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators.mutual_info import binned_from_counts, counted_classes, mutual_info_from_counts, value_counts
from vicinal.sources.store import FIRST_BATCH, finished, index_meta, named_batch, write_meta


def _folder(path: str, build: str, batch: str) -> str:
    return f"{path}/counts/{build}/batch={batch}"


def save_counts(rows: DataFrame, path: str, names: Sequence[str], signature: str) -> None:
    """Count (features, label) and write the counts under a fingerprint of what they are counts of."""
    value_counts(rows).write.mode("overwrite").parquet(_folder(path, signature, FIRST_BATCH))
    write_meta(rows.sparkSession, path, signature=signature, build=signature, batches=[FIRST_BATCH], names=list(names))


def append_counts(rows: DataFrame, path: str, batch: str) -> str:
    """Count a named batch; the new fingerprint. A batch that is sent again replaces itself."""
    named_batch(batch)
    spark = rows.sparkSession
    meta = index_meta(spark, path)
    value_counts(rows).write.mode("overwrite").parquet(_folder(path, meta["build"], batch))
    batches = sorted({*meta["batches"]} - {FIRST_BATCH} | {batch})
    signature = hashlib.sha256("\n".join([meta["build"], *batches]).encode("utf-8")).hexdigest()
    write_meta(spark, path, **meta | {"batches": [FIRST_BATCH, *batches], "signature": signature})
    return signature


def load_counts(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """((pos, v, y, c) over all batches, feature names)."""
    meta = index_meta(spark, path)
    folders = [_folder(path, meta["build"], b) for b in meta["batches"]]
    if not all(finished(spark, f) for f in folders):
        raise ValueError(f"counts are incomplete: {path}")
    counts = spark.read.parquet(*folders)
    return counts.groupBy("pos", "v", "y").agg(F.sum("c").alias("c")), meta["names"]


def stored_scores(spark: SparkSession, path: str) -> DataFrame:
    """(feature, score): ``mutual_info`` over all rows counted so far."""
    return mutual_info_from_counts(*load_counts(spark, path))


def stored_binned_scores(spark: SparkSession, path: str, bins: int = 10) -> DataFrame:
    """(feature, score): ``mutual_info_binned`` over all rows counted so far."""
    counts, names = load_counts(spark, path)
    return binned_from_counts(counts, names, sum(counted_classes(counts).values()), bins)
