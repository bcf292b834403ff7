"""Neighbours under many leading parts of the vectors, from one pass over the index.

The columns of a vector are in order of importance, and a prefix is its first p columns. A task multiplies two blocks
one slab of columns at a time. Products and squared lengths are running sums, read off wherever a prefix ends, so all
prefixes together cost about as much as the longest one alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vicinal.functions import vectors as V
from vicinal.operators.blocks import (
    BOX_DIM,
    EXACT_CELLS,
    INDEX_TILE,
    QUERY_TILE,
    as_matrix,
    exact_scores,
    in_query_order,
    nearest_in_boxes,
    norms,
    surplus_copies,
)
from vicinal.operators.knn import BLOCK_BYTES, FEW_BYTES, MOST_PARTITIONS, block_of, check_search, grid_shape, score_name, side_size
from vicinal.session import parallelism

TINY = 2.0**-120  # what a product may lose by underflow


def check_prefixes(prefixes: Sequence[int], dim: int) -> list[int]:
    wanted = sorted(set(prefixes))
    if not wanted or wanted[0] <= 0 or dim and wanted[-1] > dim:
        raise ValueError(f"prefixes must lie between 1 and the vector length {dim}: {wanted}")
    return wanted


def _running_norms(matrix: np.ndarray, prefixes: list[int]) -> np.ndarray:
    """Length of every row's prefixes, prefixes x rows."""
    total, out = np.zeros(len(matrix)), []
    for begin, end in zip([0, *prefixes], prefixes):
        total = total + np.square(matrix[:, begin:end].astype(np.float64)).sum(axis=1)
        out.append(np.sqrt(total))
    return np.array(out)


def _scores(product: np.ndarray, nq: np.ndarray, nx: np.ndarray, metric: str, room: float) -> tuple[np.ndarray, np.ndarray]:
    """(score, bound of its rounding error) of single-precision running products."""
    if metric == "cosine":
        scale = np.multiply.outer(nq, nx)
        some = scale > 0
        score = np.divide(product, scale, out=np.zeros(product.shape), where=some)
        return score, np.where(some, room + np.divide(TINY, scale, out=np.zeros(product.shape), where=some), 0.0)
    error = room * np.multiply.outer(nq, nx) + TINY
    if metric == "ip":
        return product.astype(np.float64), error
    squares = np.square(nq)[:, None] + np.square(nx)[None, :]
    return 2.0 * product - squares, 2 * error + room * squares


def best_by_prefix(
    q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, prefixes: list[int], metric: str
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(prefix, query rows, index rows, scores), score descending then id ascending, at most k per query row and prefix.

    As ``best_in_block``: single precision chooses, and whatever could be among the k best is scored again in double. Few columns
    under L2 are searched box by box instead, one prefix after the other, which compares far fewer pairs.
    """
    if metric == "l2" and prefixes[-1] <= BOX_DIM:
        for prefix in prefixes:
            near = nearest_in_boxes(np.ascontiguousarray(q[:, :prefix]), np.ascontiguousarray(x[:, :prefix]), ids, k)
            yield prefix, *in_query_order(*near)
        return
    kept = surplus_copies(ids, x, k) if len(ids) > k else np.arange(len(ids))
    x, ids = x[kept], ids[kept]
    k = min(k, len(ids))
    if metric == "cosine":
        a, b = (m / np.where((n := norms(m)) > 0, n, 1.0)[:, None] for m in (q, x))
    else:
        largest = max(float(norms(q).max()), float(norms(x).max())) or 1.0
        a, b = q / largest, x / largest
    a, b = a.astype(np.float32), b.astype(np.float32)
    room = (prefixes[-1] + 16) * 2.0**-23
    length_a, length_b = _running_norms(a, prefixes), _running_norms(b, prefixes)
    for start in range(0, len(q), QUERY_TILE):
        tile = slice(start, start + QUERY_TILE)
        rows_here = len(a[tile])
        top = np.full((len(prefixes), rows_here, k), -np.inf)
        found: list[list[tuple]] = [[] for _ in prefixes]
        for begin in range(0, len(b), INDEX_TILE):
            part = slice(begin, begin + INDEX_TILE)
            product = np.zeros((rows_here, len(b[part])), np.float32)
            for i, (low, high) in enumerate(zip([0, *prefixes], prefixes)):
                product += a[tile, low:high] @ b[part, low:high].T
                score, error = _scores(product, length_a[i, tile], length_b[i, part], metric, room)
                reach = score + error
                hit = np.flatnonzero((reach >= top[i].min(axis=1)[:, None]).any(axis=1))
                if not len(hit):
                    continue
                merged = np.concatenate([top[i, hit], score[hit] - error[hit]], axis=1)
                top[i, hit] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
                r, c = np.nonzero(reach[hit] >= top[i, hit].min(axis=1)[:, None])
                found[i].append((hit[r], c + begin, reach[hit[r], c]))
        for i, prefix in enumerate(prefixes):
            rows, cols, reach = (np.concatenate(f) for f in zip(*found[i]))
            last = reach >= top[i].min(axis=1)[rows]
            rows, cols = rows[last] + start, cols[last]
            step = max(1, EXACT_CELLS // prefix)
            pieces = [slice(at, at + step) for at in range(0, len(rows), step)]
            scores = np.concatenate([exact_scores(metric, q[rows[p], :prefix], x[cols[p], :prefix]) for p in pieces])
            order = np.lexsort((ids[cols], -scores, rows))
            rows, cols, scores = rows[order], cols[order], scores[order]
            best = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
            yield prefix, rows[best], kept[cols[best]], scores[best]


def _kernel(
    k: int, prefixes: list[int], metric: str, query_id: str, index_id: str, carry: Sequence[str], schema: pa.Schema
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return schema.empty_table()
        q, x = as_matrix(queries["vec"], "queries"), as_matrix(index["vec"], "index")
        if q.shape[1] != x.shape[1]:
            raise ValueError(f"query length {q.shape[1]} differs from index length {x.shape[1]}")
        ids = index[index_id].combine_chunks()
        order = pc.array_sort_indices(ids).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        parts = []
        for prefix, rows, cols, scores in best_by_prefix(q, x, place, k, prefixes, metric):
            columns = [queries[query_id].take(pa.array(rows)), pa.array(np.full(len(rows), prefix, np.int32))]
            columns += [index[c].take(pa.array(cols)) for c in (index_id, *carry)]
            columns.append(pa.array(-scores if metric == "l2" else scores, type=pa.float64()))
            parts.append(pa.table(columns, names=schema.names).cast(schema))
        return pa.concat_tables(parts)

    return run


def prefix_join(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    prefixes: Sequence[int],
    metric: str = "cosine",
    *,
    query_id: str = "query_id",
    index_id: str = "sample_id",
    vec: str = "vec",
    carry: Sequence[str] = ("label",),
    few_bytes: int = FEW_BYTES,
) -> DataFrame:
    """(query_id, prefix, rank, index id, carried columns, similarity or distance): ``knn_join`` of every prefix at once.

    The index is read once. Queries of up to ``few_bytes`` travel to it and nothing of it is shuffled; more queries meet
    it in a grid of blocks. Only k rows per query, prefix and block go on to be merged.
    """
    check_search(k, metric)
    spark = queries.sparkSession
    queries = queries.select(query_id, V.as_float(F.col(vec)).alias("vec"))
    index = index.select(index_id, *carry, V.as_float(F.col(vec)).alias("vec"))
    (n_query, dim) = side_size(queries, "vec")
    wanted = check_prefixes(prefixes, dim)
    score = T.StructField(score_name(metric), T.DoubleType())
    fields = [queries.schema[query_id], T.StructField("prefix", T.IntegerType()), *[index.schema[c] for c in (index_id, *carry)], score]
    schema = T.StructType(fields)
    kernel = _kernel(k, wanted, metric, query_id, index_id, carry, to_arrow_schema(schema))
    if n_query * dim * 4 <= few_bytes:
        sent = spark.sparkContext.broadcast(queries.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.nbytes for b in held) >= BLOCK_BYTES:
                    yield from kernel(sent.value, pa.Table.from_batches(held)).to_batches()
                    held = []
            if held:
                yield from kernel(sent.value, pa.Table.from_batches(held)).to_batches()

        matches = index.mapInArrow(scan, schema)
    else:
        n_index, _ = side_size(index, "vec")
        q_blocks, i_blocks = grid_shape(n_query, n_index, dim, parallelism(spark))
        every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (q_blocks, i_blocks)]
        left = queries.withColumn("qb", block_of(F.col(query_id), q_blocks)).withColumn("ib", every[1])
        right = index.withColumn("ib", block_of(F.col(index_id), i_blocks)).withColumn("qb", every[0])
        tasks = min(2 * q_blocks * i_blocks, MOST_PARTITIONS)
        sides = [side.repartition(tasks, "qb", "ib").groupBy("qb", "ib") for side in (left, right)]
        matches = sides[0].cogroup(sides[1]).applyInArrow(kernel, schema)
    by = F.col(score.name).asc() if metric == "l2" else F.col(score.name).desc()
    order = Window.partitionBy(query_id, "prefix").orderBy(by, F.col(index_id))
    ranked = matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(query_id, "prefix", "rank", *[f.name for f in fields[2:]])
