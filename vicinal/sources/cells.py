"""A stored index laid out by cell, so that a search reads only what its queries can reach.

Below one folder per build lie the pivots of both levels, which never change, and per named batch of rows the rows, partitioned by
coarse cell and sorted by fine cell, and the bounds of the cells they fell into. Appending assigns the new rows to the pivots
that are there and writes the batch's own bounds; the index's bounds are those of all batches merged. The metadata names the
batches that count and is written last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators.knn import check_search
from vicinal.operators.tree import CELL_ROWS, Cells, Tree, as_cells, grow, measure, merged, place
from vicinal.sources.store import FIRST_BATCH, finished, index_meta, named_batch, write_meta

LAYOUT = "cells"


def _folders(path: str, build: str, batch: str) -> tuple[str, str, str]:
    base = f"{path}/rows/{build}"
    return f"{base}/rows/batch={batch}", f"{base}/fine/batch={batch}", f"{base}/coarse/batch={batch}"


def _write_batch(rows: DataFrame, tree: Tree, path: str, build: str, batch: str) -> None:
    spark = rows.sparkSession
    at, fine_at, coarse_at = _folders(path, build, batch)
    placed = place(rows, tree)
    placed.sortWithinPartitions("coarse", "fine").write.mode("overwrite").partitionBy("coarse").parquet(at)
    # without rows no partition is written and nothing can be read back
    empty = not finished(spark, at) or rows.isEmpty()
    fine, coarse = measure(placed.limit(0) if empty else spark.read.schema(placed.schema).parquet(at))
    fine.write.mode("overwrite").parquet(fine_at)
    coarse.write.mode("overwrite").parquet(coarse_at)


def save_cells(rows: DataFrame, path: str, *, signature: str, metric: str = "cosine", cell_rows: int = CELL_ROWS, coarse_cells: int | None = None) -> None:
    """Write (sample_id, vec, ...) in cells for one metric. Rows must be there: without them there are no pivots."""
    check_search(1, metric)
    tree = grow(rows, "sample_id", metric, cell_rows, coarse_cells)
    base = f"{path}/rows/{signature}"
    spark = rows.sparkSession
    pivots = spark.createDataFrame([(c, p.tolist()) for c, p in enumerate(tree.pivots)], "coarse int, pivot array<double>")
    pivots.write.mode("overwrite").parquet(f"{base}/pivots")
    tree.fine.write.mode("overwrite").parquet(f"{base}/fine-pivots")
    _write_batch(rows, tree, path, signature, FIRST_BATCH)
    write_meta(spark, path, layout=LAYOUT, signature=signature, build=signature, batches=[FIRST_BATCH], metric=metric)


def _tree(spark: SparkSession, path: str, meta: dict) -> Tree:
    base = f"{path}/rows/{meta['build']}"
    pivots = sorted(spark.read.parquet(f"{base}/pivots").collect())  # bounded when they were chosen
    return Tree(np.array([r["pivot"] for r in pivots]), spark.read.parquet(f"{base}/fine-pivots"), meta["metric"])


def append_cells(rows: DataFrame, path: str, batch: str) -> str:
    """Add a named batch and return the new fingerprint. A batch that is sent again replaces itself.

    Pivots stay, so cells grow with what is appended; an index that has grown many times over is better built anew.
    """
    named_batch(batch)
    spark = rows.sparkSession
    meta = index_meta(spark, path)
    _write_batch(rows, _tree(spark, path, meta), path, meta["build"], batch)
    batches = sorted({*meta["batches"]} - {FIRST_BATCH} | {batch})
    signature = hashlib.sha256("\n".join([meta["build"], *batches]).encode("utf-8")).hexdigest()
    write_meta(spark, path, **meta | {"batches": [FIRST_BATCH, *batches], "signature": signature})
    return signature


def cells_exist(spark: SparkSession, path: str) -> bool:
    """Metadata and all batches that it names are complete."""
    if not finished(spark, f"{path}/meta"):
        return False
    meta = index_meta(spark, path)
    return meta.get("layout") == LAYOUT and all(finished(spark, f) for b in meta["batches"] for f in _folders(path, meta["build"], b))


def open_cells(spark: SparkSession, path: str, batches: Sequence[str] | None = None) -> tuple[Cells, dict]:
    """(cells, metadata), for ``tree.search_cells``. Rows are only planned here: which cells are read is up to the search."""
    meta = index_meta(spark, path)
    if meta.get("layout") != LAYOUT:
        raise ValueError("the index is not laid out by cell")
    base = f"{path}/rows/{meta['build']}"
    counted = F.col("batch").isin(list(batches or meta["batches"]))
    rows = spark.read.parquet(f"{base}/rows").where(counted).drop("batch", "coarse_distance", "fine_distance")
    fine = merged(spark.read.parquet(f"{base}/fine").where(counted), "coarse", "fine")
    coarse = merged(spark.read.parquet(f"{base}/coarse").where(counted), "coarse")
    return as_cells(_tree(spark, path, meta), rows, fine, coarse), meta
