"""Exact k-nearest-neighbour join.

Both sides are cut into blocks of bounded size; a task gets one pair of blocks, multiplies the two
matrices and returns only the ``k`` best index rows of each query row. A window per query merges the
blocks. Results are exact and totally ordered by (score, index id), so the block layout never shows.

``knn_few`` sends a small query side to the index instead. ``knn_join`` compares every pair of blocks. ``knn_join_pruned`` groups the index around pivot vectors
first and skips every group that the triangle inequality proves too far away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vicinal.functions import vectors as V
from vicinal.config import METRICS
from vicinal.operators.blocks import as_matrix, best_in_block
from vicinal.operators.validate import finite
from vicinal.session import parallelism

BLOCK_BYTES = 64 * 1024 * 1024
MIN_QUERY_BLOCK, MIN_INDEX_BLOCK = 256, 2048  # no smaller blocks just to have more of them
PAIRS_PER_CORE = 4
MOST_PARTITIONS = 20_000
FEW_BYTES = 64 * 1024 * 1024  # of query vectors that every task may hold


def score_name(metric: str) -> str:
    return "distance" if metric == "l2" else "similarity"


def check_search(k: int, metric: str) -> None:
    if k <= 0:
        raise ValueError("k must be greater than zero")
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is not supported")


def side_size(df: DataFrame, vec: str) -> tuple[int, int]:
    """(rows, vector length). Neither reads the vectors of the whole table; lengths are checked later."""
    first = df.where(F.col(vec).isNotNull()).select(F.size(vec).alias("dim")).first()
    return (df.count(), int(first["dim"])) if first else (0, 0)


def _blocks(rows: int, dim: int, block_bytes: int) -> int:
    return max(1, math.ceil(rows * max(1, dim) * 4 / block_bytes))


def grid_shape(
    n_query: int, n_index: int, dim: int, cores: int, block_bytes: int = BLOCK_BYTES
) -> tuple[int, int]:
    """(query blocks, index blocks): what the block size asks for, or more to give every core work.

    A query is sent to every index block and an index row to every query block, so extra blocks go to
    the longer side, which keeps the number of rows sent small.
    """
    q, i = _blocks(n_query, dim, block_bytes), _blocks(n_index, dim, block_bytes)
    pairs = PAIRS_PER_CORE * cores
    if q * i < pairs and n_query and n_index:
        i = max(i, min(math.ceil(math.sqrt(pairs * n_index / n_query)), math.ceil(n_index / MIN_INDEX_BLOCK)))
        q = max(q, min(math.ceil(pairs / i), math.ceil(n_query / MIN_QUERY_BLOCK)))
    return q, i


def block_of(id_column: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(blocks)).cast("int")


def pair_kernel(k: int, metric: str, query_id: str, index_id: str, carry: Sequence[str], out_schema: pa.Schema):
    """Cogroup function: query block and index block in, best matches out."""

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return out_schema.empty_table()
        q, x = as_matrix(queries["vec"], "queries"), as_matrix(index["vec"], "index")
        if q.shape[1] != x.shape[1]:
            raise ValueError(f"query length {q.shape[1]} differs from index length {x.shape[1]}")
        ids = index[index_id].combine_chunks()
        order = pc.array_sort_indices(ids).to_numpy()
        id_rank = np.empty(len(order), dtype=np.int64)  # ids of any type as positions in id order
        id_rank[order] = np.arange(len(order))
        rows, cols, scores = best_in_block(q, x, id_rank, k, metric)
        columns = [queries[query_id].take(pa.array(rows)), index[index_id].take(pa.array(cols))]
        columns += [index[c].take(pa.array(cols)) for c in carry]
        columns.append(pa.array(-scores if metric == "l2" else scores, type=pa.float64()))
        return pa.table(columns, names=out_schema.names).cast(out_schema)

    return run


def output_schema(queries: DataFrame, index: DataFrame, query_id: str, index_id: str, carry: Sequence[str], metric: str):
    fields = [T.StructField(query_id, queries.schema[query_id].dataType)]
    fields.append(T.StructField(index_id, index.schema[index_id].dataType))
    fields += [T.StructField(c, index.schema[c].dataType) for c in carry]
    fields.append(T.StructField(score_name(metric), T.DoubleType()))
    schema = T.StructType(fields)
    return schema, to_arrow_schema(schema)


def match_blocks(
    queries: DataFrame,
    index: DataFrame,
    keys: list[str],
    k: int,
    metric: str,
    query_id: str,
    index_id: str,
    carry: Sequence[str],
    groups: int,
) -> DataFrame:
    """Cogroup both sides on ``keys`` and keep the k best per query and group.

    ``groups`` is the number of key values. Each is heavy to compute but small in bytes, so they get
    twice as many partitions as there are groups instead of sharing few: tasks then hold one group each
    and the scheduler balances them.
    """
    schema, arrow = output_schema(queries, index, query_id, index_id, carry, metric)
    kernel = pair_kernel(k, metric, query_id, index_id, carry, arrow)
    left = queries.select(*keys, query_id, "vec")
    right = index.select(*keys, index_id, *carry, "vec")
    partitions = min(2 * groups, MOST_PARTITIONS)
    left, right = (side.repartition(partitions, *keys).groupBy(*keys) for side in (left, right))
    return left.cogroup(right).applyInArrow(kernel, schema)


def best_per_query(matches: DataFrame, k: int, metric: str, query_id: str, index_id: str) -> DataFrame:
    """Merge partial results; the window keeps k rows per query before and after the shuffle."""
    score = score_name(metric)
    by = F.col(score).asc() if metric == "l2" else F.col(score).desc()
    window = Window.partitionBy(query_id).orderBy(by, F.col(index_id))
    ranked = matches.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.select(query_id, "rank", *[c for c in matches.columns if c != query_id])


def knn_join(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    metric: str = "cosine",
    *,
    query_id: str = "query_id",
    index_id: str = "sample_id",
    vec: str = "vec",
    carry: Sequence[str] = ("label",),
    grid: tuple[int, int] | None = None,
) -> DataFrame:
    """(query_id, rank, index id, carried columns, similarity or distance), k rows per query.

    ``grid`` is (query blocks, index blocks); by default it follows from the size of both sides. Each
    index row travels once per query block and the other way round, so blocks are as large as one task
    can hold and no larger.
    """
    check_search(k, metric)
    queries = queries.select(query_id, V.as_float(F.col(vec)).alias("vec"))
    index = index.select(index_id, *carry, V.as_float(F.col(vec)).alias("vec"))
    if grid is None:
        (n_query, dim), (n_index, _) = side_size(queries, "vec"), side_size(index, "vec")
        grid = grid_shape(n_query, n_index, dim, parallelism(queries.sparkSession))
    q_blocks, i_blocks = grid
    left = queries.withColumn("qb", block_of(F.col(query_id), q_blocks)).withColumn(
        "ib", F.explode(F.sequence(F.lit(0), F.lit(i_blocks - 1)))
    )
    right = index.withColumn("ib", block_of(F.col(index_id), i_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    matches = match_blocks(left, right, ["qb", "ib"], k, metric, query_id, index_id, carry, q_blocks * i_blocks)
    return best_per_query(matches, k, metric, query_id, index_id)


def knn_few(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    metric: str = "cosine",
    *,
    query_id: str = "query_id",
    index_id: str = "sample_id",
    vec: str = "vec",
    carry: Sequence[str] = ("label",),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """As ``knn_join``, for queries of at most ``FEW_BYTES``: they travel to the index, which is read where it lies.

    Only the best k rows of each query and block are shuffled. More queries than that are refused.
    """
    check_search(k, metric)
    spark = queries.sparkSession
    queries = queries.select(query_id, V.as_float(F.col(vec)).alias("vec"))
    index = index.select(index_id, *carry, V.as_float(F.col(vec)).alias("vec"))
    rows, dim = side_size(queries, "vec")
    if rows * dim * 4 > FEW_BYTES:
        raise ValueError(f"{rows} queries of length {dim} are too many to be sent to every task")
    schema, arrow = output_schema(queries, index, query_id, index_id, carry, metric)
    kernel = pair_kernel(k, metric, query_id, index_id, carry, arrow)
    sent = spark.sparkContext.broadcast(queries.toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> Iterator[pa.RecordBatch]:
            yield from kernel(sent.value, pa.Table.from_batches(held)).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= block_bytes:
                yield from block()
                held = []
        if held:
            yield from block()

    return best_per_query(index.mapInArrow(scan, schema), k, metric, query_id, index_id)


def knn_single(
    index: DataFrame,
    vector: Sequence[float],
    k: int,
    metric: str = "cosine",
    *,
    index_id: str = "sample_id",
    vec: str = "vec",
    carry: Sequence[str] = ("label",),
) -> DataFrame:
    """Best k index rows for one vector: a scan with one expression and a bounded top-k."""
    check_search(k, metric)
    if not np.isfinite(np.asarray(vector, dtype=np.float64)).all():
        raise ValueError("null, NaN or infinite value in the query")
    query = V.as_float(F.lit([float(x) for x in vector]))
    stored = finite(V.as_float(F.col(vec)), "index")
    same = F.assert_true(F.size(stored) == len(vector), F.lit(f"query length {len(vector)} differs from index length"))
    stored = F.when(same.isNull(), stored)
    score = {"cosine": V.cosine, "ip": V.dot, "l2": V.squared_distance}[metric](stored, query)
    name = score_name(metric)
    by = F.col(name).asc() if metric == "l2" else F.col(name).desc()
    return index.select(index_id, *carry, score.alias(name)).orderBy(by, index_id).limit(k)


def neighbor_metadata(neighbors: DataFrame, rows: DataFrame, index_id: str = "sample_id") -> DataFrame:
    """Attach stored columns (raw vector, text, original id) to the neighbours by id."""
    return neighbors.join(rows, index_id, "left")
