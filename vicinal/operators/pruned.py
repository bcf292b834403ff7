"""Exact kNN join that leaves out what cannot matter.

The index is grouped around pivot rows into cells. A query first searches the closest cells that hold
``k`` rows; its k-th score then rules out every other cell that the triangle inequality proves too far
away, and only the rest is searched. Nothing is approximated: a cell is skipped only on proof, and where
the data has no structure the second pass simply visits all of it.

Cells are cut into blocks of bounded size, and so are the queries that visit a cell, so neither a cell
that holds a third of all rows nor one that every query visits ends up in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.functions import vectors as V
from vicinal.operators.blocks import as_matrix, distances, in_space, nearest_cells, reachable_cells
from vicinal.operators.knn import (
    BLOCK_BYTES,
    MIN_QUERY_BLOCK,
    best_per_query,
    block_of,
    check_search,
    match_blocks,
    score_name,
    side_size,
)
from vicinal.session import materialize, parallelism

PIVOT_BYTES = 16 * 1024 * 1024  # pivots travel to every executor; their size is bounded by this
CELLS_PER_BLOCK = 4


def cell_count(n_index: int, dim: int, block_bytes: int = BLOCK_BYTES) -> int:
    """A few cells per block: finer cells skip more but send each query to more places."""
    wanted = CELLS_PER_BLOCK * math.ceil(n_index * dim * 4 / block_bytes)
    return max(1, min(wanted, PIVOT_BYTES // (8 * max(1, dim)), n_index))


def choose_pivots(index: DataFrame, index_id: str, cells: int, metric: str) -> np.ndarray:
    """Index rows with the smallest id hash, without repeats: a bounded number of vectors."""
    rows = index.select("vec", F.xxhash64(index_id).alias("h"), index_id).orderBy("h", index_id).limit(cells)
    table = rows.select("vec").toArrow()
    return np.unique(in_space(as_matrix(table["vec"], "index"), metric), axis=0)


def map_vectors(
    df: DataFrame, metric: str, add: Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]], fields: list[T.StructField]
) -> DataFrame:
    """Append columns computed from the vectors of an Arrow batch."""
    schema = T.StructType([*df.schema.fields, *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = in_space(as_matrix(batch.column(names.index("vec")), "vectors"), metric)
                yield pa.RecordBatch.from_arrays([*batch.columns, *add(batch, points)], names=names)

    return df.mapInArrow(run, schema)


def assign_cells(index: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Add ``cell`` and ``pivot_distance``."""
    shared = index.sparkSession.sparkContext.broadcast(pivots)

    def add(_: pa.RecordBatch, points: np.ndarray) -> list[pa.Array]:
        d = distances(points, shared.value)
        cell = d.argmin(axis=1)
        return [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])]

    return map_vectors(
        index, metric, add, [T.StructField("cell", T.IntegerType()), T.StructField("pivot_distance", T.DoubleType())]
    )


def _search_cells(
    visits: DataFrame,
    index: DataFrame,
    index_blocks: np.ndarray,
    k: int,
    metric: str,
    query_id: str,
    index_id: str,
    carry: Sequence[str],
    query_rows: int,
) -> DataFrame:
    """Best k per query and block. ``visits`` is (query id, vec, cells)."""
    spark = visits.sparkSession
    visited = visits.select(F.explode_outer("cells").alias("cell")).filter("cell IS NOT NULL")
    asked = {r["cell"]: r["n"] for r in visited.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    # one row per cell, and the number of cells is bounded with the pivots
    blocks = [(c, int(index_blocks[c]), math.ceil(n / query_rows)) for c, n in asked.items()]
    plan = spark.createDataFrame(blocks, "cell int, index_blocks int, query_blocks int")
    groups = max(1, sum(i * q for _, i, q in blocks))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def hashed(key: str, count: str):
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    left = (
        visits.select(query_id, "vec", F.explode("cells").alias("cell"))
        .join(F.broadcast(plan), "cell")
        .withColumn("qb", hashed(query_id, "query_blocks"))
        .withColumn("ib", every("index_blocks"))
    )
    right = (
        index.join(F.broadcast(plan), "cell")
        .withColumn("ib", hashed(index_id, "index_blocks"))
        .withColumn("qb", every("query_blocks"))
    )
    return match_blocks(left, right, ["cell", "ib", "qb"], k, metric, query_id, index_id, carry, groups)


def knn_join_pruned(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    metric: str = "cosine",
    *,
    query_id: str = "query_id",
    index_id: str = "sample_id",
    vec: str = "vec",
    carry: Sequence[str] = ("label",),
    cells: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Same result as ``knn_join``."""
    check_search(k, metric)
    spark = queries.sparkSession
    queries = queries.select(query_id, V.as_float(F.col(vec)).alias("vec"))
    index = index.select(index_id, *carry, V.as_float(F.col(vec)).alias("vec"))
    (n_query, dim), (n_index, _) = side_size(queries, "vec"), side_size(index, "vec")
    rows_per_block = max(1, block_bytes // (4 * max(1, dim)))
    query_rows = max(1, min(rows_per_block, max(MIN_QUERY_BLOCK, math.ceil(n_query / parallelism(spark)))))

    pivots = choose_pivots(index, index_id, cells or cell_count(n_index, dim, block_bytes), metric)
    placed = materialize(assign_cells(index, pivots, metric))
    stats = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("pivot_distance").alias("low"), F.max("pivot_distance").alias("high")
    )
    count, low, high = (np.zeros(len(pivots)) for _ in range(3))
    for r in stats.collect():  # one row per cell
        count[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    index_blocks = np.maximum(1, np.ceil(count / rows_per_block)).astype(int)
    placed = placed.drop("pivot_distance")
    shared = spark.sparkContext.broadcast((pivots, count, low, high))
    cells_field = [T.StructField("cells", T.ArrayType(T.IntegerType()))]
    list_type = pa.list_(pa.int32())

    def near(_: pa.RecordBatch, points: np.ndarray) -> list[pa.Array]:
        p, n, _low, _high = shared.value
        return [pa.array([c.astype(np.int32) for c in nearest_cells(points, p, n, k)], type=list_type)]

    home = materialize(map_vectors(queries, metric, near, cells_field))
    search = dict(
        k=k, metric=metric, query_id=query_id, index_id=index_id, carry=carry, query_rows=query_rows
    )
    first = materialize(
        best_per_query(_search_cells(home, placed, index_blocks, **search), k, metric, query_id, index_id)
    )

    score = score_name(metric)
    kth = first.filter(F.col("rank") == k).select(
        query_id, (-F.col(score) if metric == "l2" else F.col(score)).alias("kth")
    )
    names = ["vec", "home", "kth"]

    def rest(batch: pa.RecordBatch, points: np.ndarray) -> list[pa.Array]:
        p, n, lo, hi = shared.value
        value = np.nan_to_num(batch.column(names.index("kth") + 1).to_numpy(zero_copy_only=False), nan=-np.inf)
        mask = reachable_cells(points, p, lo, hi, value, metric) & (n > 0)[None, :]
        for row, done in enumerate(batch.column(names.index("home") + 1).to_pylist()):
            mask[row, done] = False
        return [pa.array([np.flatnonzero(m).astype(np.int32) for m in mask], type=list_type)]

    bounded = home.withColumnRenamed("cells", "home").join(kth, query_id, "left").select(query_id, *names)
    more = materialize(map_vectors(bounded, metric, rest, cells_field).select(query_id, "vec", "cells"))
    second = _search_cells(more, placed, index_blocks, **search)
    return best_per_query(first.drop("rank").unionByName(second), k, metric, query_id, index_id)
