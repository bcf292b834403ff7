"""A pivot tree of two levels: cells whose number grows with the index, and exact search over them.

Coarse pivots are few enough to travel to every task. Every row is also grouped, inside its coarse cell, around fine pivots:
one for about ``cell_rows`` rows, so cells keep their size however large the index is. The fine pivots are a distributed
table and meet rows and queries by coarse cell; nothing on the driver or in a broadcast grows with their number.

A search goes down both levels. The k-th score in the closest cells rules out coarse cells by their distances to the
coarse pivot, and then, in those that are left, fine cells by their distances to the fine pivot. Each bound is the triangle
inequality on its own level, so what passes both is all that can matter, and results are those of ``knn_join``.

Coarse cells travel in groups of a bounded number of rows, together with the bounds of their fine cells. A query is sent once
to each group that holds a cell it can reach, and the fine cells are chosen there. So data without structure, where every
query reaches every cell, costs as many copies of a query as there are groups, and never one per fine cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vicinal.functions import vectors as V
from vicinal.operators.blocks import as_matrix, best_in_block, distances, in_space, nearest_cells, reachable_cells
from vicinal.operators.knn import (
    BLOCK_BYTES,
    MIN_QUERY_BLOCK,
    MOST_PARTITIONS,
    best_per_query,
    check_search,
    output_schema,
    score_name,
    side_size,
)
from vicinal.operators.pruned import PIVOT_BYTES, choose_pivots, map_vectors
from vicinal.session import materialize, parallelism, stored

CELL_ROWS = 4096
FINE_BYTES = 64 * 1024 * 1024
"""of fine pivots that a task holds, those of one coarse cell; a denser coarse cell has larger fine cells"""

GROUP_ROWS = 1 << 16
"""rows of coarse cells that travel together"""
QUERY_TILE = 512
"""queries that are neighbours and share the choice of fine cells"""
PAIRS_AT_ONCE = 1 << 21
"""distances to pivots that a task holds at one time"""

ROW = T.StructField("coarse", T.IntegerType()), T.StructField("fine", T.IntegerType())


@dataclass(frozen=True)
class Tree:
    """``pivots``: coarse pivots as points. ``fine``: (coarse, fine, pivot). Rows of an index are assigned to (coarse, fine)."""

    pivots: np.ndarray
    fine: DataFrame
    metric: str


@dataclass(frozen=True)
class Cells:
    """An index in cells. ``rows``: (coarse, fine, sample_id, vec, ...). ``bounds``: (coarse, fine, pivot, n, low, high).

    ``coarse``: per coarse cell, number of rows, smallest and largest distance to the coarse pivot.
    """

    tree: Tree
    rows: DataFrame
    bounds: DataFrame
    coarse: tuple[np.ndarray, np.ndarray, np.ndarray]


def coarse_count(n_index: int, dim: int, cell_rows: int) -> int:
    """As many coarse cells as fine ones in each, within what may travel to every task."""
    return max(1, min(math.ceil(math.sqrt(n_index / cell_rows)), PIVOT_BYTES // (8 * max(1, dim)), max(1, n_index)))


def _slabs(rows: int, cells: int, most: int = 4096) -> Iterator[slice]:
    """Rows cut so that their distances to all ``cells`` fit in memory."""
    step = max(1, min(most, PAIRS_AT_ONCE // max(1, cells)))
    return (slice(begin, begin + step) for begin in range(0, rows, step))


def _closest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the closest pivot, distance to it) of every point."""
    at, far = np.zeros(len(points), np.int32), np.zeros(len(points))
    for some in _slabs(len(points), len(pivots)):
        d = distances(points[some], pivots)
        at[some] = d.argmin(axis=1)
        far[some] = d[np.arange(len(d)), at[some]]
    return at, far


def _coarse(rows: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Adds ``coarse`` and ``coarse_distance``."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def add(_: pa.RecordBatch, points: np.ndarray) -> list[pa.Array]:
        return [pa.array(column) for column in _closest(points, shared.value)]

    return map_vectors(rows, metric, add, [ROW[0], T.StructField("coarse_distance", T.DoubleType())])


def _with_fine(
    side: DataFrame, fine: DataFrame, key: str, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, block_bytes: int, dim: int
) -> DataFrame:
    """Brings rows and the fine pivots of their coarse cell together.

    The rows of a cell are cut into chunks of bounded size by a hash of ``key``, and the cell's pivots go to each
    chunk, so a coarse cell that holds a third of all rows is many tasks.
    """
    chunk_rows = max(1, min(GROUP_ROWS, block_bytes // (4 * max(1, dim))))
    counted = side.groupBy("coarse").count().collect()  # one row per coarse cell
    plan = [(r["coarse"], -(-r["count"] // chunk_rows)) for r in counted]
    chunks = side.sparkSession.createDataFrame(plan, "coarse int, chunks int")
    left = side.join(F.broadcast(chunks), "coarse").withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int")).drop("chunks")
    right = fine.join(F.broadcast(chunks), "coarse").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    tasks = max(parallelism(side.sparkSession), min(2 * sum(n for _, n in plan), 20_000))
    left, right = (s.repartition(tasks, "coarse", "chunk").groupBy("coarse", "chunk") for s in (left, right))
    return left.cogroup(right).applyInArrow(fn, schema)


def grow(index: DataFrame, index_id: str, metric: str, cell_rows: int = CELL_ROWS, coarse_cells: int | None = None) -> Tree:
    """Pivots for (``index_id``, vec). All are rows of the index, chosen by a hash of the id, so every run chooses the same."""
    n, dim = side_size(index, "vec")
    if not n:
        raise ValueError("no rows to search")
    spark = index.sparkSession
    pivots = choose_pivots(index, index_id, coarse_cells or coarse_count(n, dim, cell_rows), metric)
    at_most = max(1, FINE_BYTES // (8 * max(1, dim)))
    drawn = index.where(F.pmod(F.xxhash64(F.lit(1), index_id), F.lit(cell_rows)) == 0).select(index_id, "vec")
    placed = _coarse(drawn, pivots, metric).withColumn("pivot", _points("vec", metric))
    single = placed.groupBy("coarse", "pivot").agg(F.min(F.struct(F.xxhash64(index_id).alias("h"), index_id)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("coarse").orderBy("first"))
    fine = single.select("coarse", nth.alias("fine"), "pivot").where(F.col("fine") < at_most)
    home = spark.createDataFrame([(c, 0, p.tolist()) for c, p in enumerate(pivots)], "coarse int, fine int, pivot array<double>")
    return Tree(pivots, stored(fine.unionByName(home), "pivots"), metric)


def _points(vec: str, metric: str):
    return V.l2_normalize(F.col(vec)) if metric == "cosine" else V.as_double(F.col(vec))


def place(rows: DataFrame, tree: Tree, index_id: str = "sample_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds coarse, fine, coarse_distance and fine_distance to (``index_id``, vec, ...)."""
    _, dim = side_size(rows, "vec")
    coarse = _coarse(rows, tree.pivots, tree.metric)
    schema = T.StructType([*coarse.schema.fields, ROW[1], T.StructField("fine_distance", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    metric = tree.metric

    def assign(own: pa.Table, fine: pa.Table) -> pa.Table:
        if not own.num_rows:
            return arrow.empty_table()
        own = own.drop_columns(["chunk"])
        pivots, number = _pivots(fine), fine["fine"].to_numpy()
        at, far = [], []
        for begin in range(0, own.num_rows, 4096):
            best, away = _closest(in_space(as_matrix(own["vec"].slice(begin, 4096), "index"), metric), pivots)
            at.append(number[best])
            far.append(away)
        own = own.append_column("fine", pa.array(np.concatenate(at).astype(np.int32)))
        return own.append_column("fine_distance", pa.array(np.concatenate(far))).select(arrow.names).cast(arrow)

    return _with_fine(stored(coarse, "coarse"), tree.fine, index_id, assign, schema, block_bytes, dim)


def _pivots(fine: pa.Table, name: str = "pivot") -> np.ndarray:
    values = fine[name].combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def measure(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(coarse, fine, n, low, high) and (coarse, n, low, high). Both can be merged with those of more rows."""
    def over(distance: str):
        return F.count(F.lit(1)).alias("n"), F.min(distance).alias("low"), F.max(distance).alias("high")

    return placed.groupBy("coarse", "fine").agg(*over("fine_distance")), placed.groupBy("coarse").agg(*over("coarse_distance"))


def merged(bounds: DataFrame, *keys: str) -> DataFrame:
    """Bounds of the same cells over several sets of rows as one: counts add up, bounds widen."""
    return bounds.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def as_cells(tree: Tree, rows: DataFrame, fine: DataFrame, coarse: DataFrame) -> Cells:
    """``fine`` and ``coarse`` as from ``measure``. Three numbers per coarse cell reach the driver."""
    n, low, high = (np.zeros(len(tree.pivots)) for _ in range(3))
    for r in coarse.collect():
        n[r["coarse"]], low[r["coarse"]], high[r["coarse"]] = r["n"], r["low"], r["high"]
    return Cells(tree, rows, tree.fine.join(fine, ["coarse", "fine"]), (n, low, high))


def build_cells(index: DataFrame, metric: str, index_id: str = "sample_id", cell_rows: int = CELL_ROWS, coarse_cells: int | None = None) -> Cells:
    """An index (``index_id``, vec, ...) in cells, written to the shared folder."""
    tree = grow(index, index_id, metric, cell_rows, coarse_cells)
    placed = stored(place(index, tree, index_id), "cells")
    fine, coarse = measure(placed)
    return as_cells(tree, placed.drop("coarse_distance", "fine_distance"), stored(fine, "bounds"), coarse)


# --- search ---------------------------------------------------------------------------------------


def reached(rows: DataFrame, visits: DataFrame) -> DataFrame:
    """Index rows of coarse cells that are visited at all. The list has at most one number per coarse cell.

    Where rows are stored by coarse cell, the others are not read.
    """
    wanted = sorted(r["coarse"] for r in visits.select("coarse").distinct().collect())
    return rows.where(F.col("coarse").isin(wanted) if wanted else F.lit(False))


def _groups(n: np.ndarray, group_rows: int) -> np.ndarray:
    """The group of every coarse cell: runs of cells in the order of their pivots, of about so many rows."""
    return ((np.cumsum(n) - n) // max(1, group_rows)).astype(np.int32)


def _few_cells(points: np.ndarray, kth: np.ndarray, k: int, fine: dict[str, np.ndarray]) -> np.ndarray:
    """Mask of (point, cell): the closest cells that hold ``k`` rows. No cell is empty, so they are among the k closest."""
    d = distances(points, fine["pivots"])
    some = min(k, d.shape[1])
    near = np.argpartition(d, some - 1, axis=1)[:, :some]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
    before = np.cumsum(fine["n"][near], axis=1) - fine["n"][near]
    mask = np.zeros(d.shape, bool)
    np.put_along_axis(mask, near, before < k, axis=1)
    return mask


def _kernel(k: int, metric: str, query_id: str, index_id: str, carry: Sequence[str], schema: pa.Schema, choose: Callable[..., np.ndarray]):
    """Cogroup function: queries, and a group of cells with their bounds, in; best matches out.

    Queries are taken in the order of the fine cell they are closest to, so that those of a tile choose much the same cells.
    """

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return schema.empty_table()
        bound = pc.is_valid(index["__n"])
        fine, index = index.filter(bound).combine_chunks(), index.filter(pc.invert(bound)).combine_chunks()
        if not index.num_rows or not fine.num_rows:
            return schema.empty_table()
        q, x = as_matrix(queries["vec"], "queries"), as_matrix(index["vec"], "index")
        if q.shape[1] != x.shape[1]:
            raise ValueError(f"query length {q.shape[1]} differs from index length {x.shape[1]}")
        kth = np.nan_to_num(queries["__kth"].to_numpy(), nan=-np.inf)  # unknown where a query has found fewer than k rows
        known = {c: fine[f"__{c}"].to_numpy().astype(np.float64) for c in ("n", "low", "high")} | {"pivots": _pivots(fine, "__pivot")}
        keys = [t["coarse"].to_numpy().astype(np.int64) << 32 | t["fine"].to_numpy() for t in (fine, index)]
        by_cell = np.argsort(keys[1], kind="stable")
        begins, ends = (np.searchsorted(keys[1][by_cell], keys[0], side=side) for side in ("left", "right"))
        order = pc.array_sort_indices(index[index_id].combine_chunks()).to_numpy()
        id_rank = np.empty(len(order), dtype=np.int64)
        id_rank[order] = np.arange(len(order))
        homes = [_closest(in_space(q[some], metric), known["pivots"])[0] for some in _slabs(len(q), 1)]
        by_home = np.argsort(np.concatenate(homes), kind="stable")
        found = []
        for some in _slabs(len(q), len(fine), QUERY_TILE):
            own = by_home[some]
            mask = choose(in_space(q[own], metric), kth[own], k, known)
            cells = np.flatnonzero(mask.any(axis=0) & (ends > begins))
            if len(cells):
                at = np.sort(by_cell[np.concatenate([np.arange(begins[c], ends[c]) for c in cells])])
                rows, cols, scores = best_in_block(q[own], x[at], id_rank[at], k, metric)
                found.append((own[rows], at[cols], scores))
        if not found:
            return schema.empty_table()
        rows, cols, scores = (np.concatenate(part) for part in zip(*found))
        columns = [queries[query_id].take(pa.array(rows)), *[index[c].take(pa.array(cols)) for c in (index_id, *carry)]]
        columns.append(pa.array(-scores if metric == "l2" else scores, type=pa.float64()))
        return pa.table(columns, names=schema.names).cast(schema)

    return run


def _search(
    visits: DataFrame, cells: Cells, group_of: np.ndarray, k: int, query_id: str, index_id: str, carry: Sequence[str],
    choose: Callable[..., np.ndarray], block_rows: int, query_rows: int,
) -> DataFrame:
    """Best k per query and block. ``visits`` is (query id, vec, __kth, groups, cells); large groups, and groups with many visitors, are cut by hash."""
    spark, metric = visits.sparkSession, cells.tree.metric
    rows_in = np.bincount(group_of, weights=cells.coarse[0])
    asked = visits.select(F.explode("groups").alias("group")).groupBy("group").count().collect()  # one row per group
    blocks = [(r["group"], max(1, math.ceil(rows_in[r["group"]] / block_rows)), math.ceil(r["count"] / query_rows)) for r in asked]
    plan = F.broadcast(spark.createDataFrame(blocks, "group int, index_blocks int, query_blocks int"))
    member = F.broadcast(spark.createDataFrame(list(enumerate(group_of.tolist())), "coarse int, group int"))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def hashed(key: str, count: str):
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    left = visits.select(query_id, "vec", "__kth", F.explode("groups").alias("group")).join(plan, "group")
    left = left.withColumn("qb", hashed(query_id, "query_blocks")).withColumn("ib", every("index_blocks"))
    seen = visits.select(F.explode("cells").alias("coarse"))
    rows = reached(cells.rows, seen).join(member, "coarse").join(plan, "group")
    bounds = reached(cells.bounds, seen).join(member, "coarse").join(plan, "group")
    keys, own = ["group", "ib", "qb"], [index_id, *carry, "vec"]
    numbers = ("pivot", "n", "low", "high")
    rows = rows.withColumn("ib", hashed(index_id, "index_blocks")).withColumn("qb", every("query_blocks"))
    bounds = bounds.withColumn("ib", every("index_blocks")).withColumn("qb", every("query_blocks"))
    of_rows = [F.lit(None).cast(cells.bounds.schema[c].dataType).alias(f"__{c}") for c in numbers]
    of_bounds = [F.lit(None).cast(cells.rows.schema[c].dataType).alias(c) for c in own]
    right = rows.select(*keys, "coarse", "fine", *own, *of_rows).unionByName(
        bounds.select(*keys, "coarse", "fine", *of_bounds, *[F.col(c).alias(f"__{c}") for c in numbers])
    )
    schema, arrow = output_schema(visits, cells.rows, query_id, index_id, carry, metric)
    kernel = _kernel(k, metric, query_id, index_id, carry, arrow, choose)
    partitions = max(1, min(2 * sum(i * q for _, i, q in blocks), MOST_PARTITIONS))
    left, right = (side.repartition(partitions, *keys).groupBy(*keys) for side in (left, right))
    return left.cogroup(right).applyInArrow(kernel, schema)


def search_cells(
    queries: DataFrame,
    cells: Cells,
    k: int,
    *,
    query_id: str = "query_id",
    index_id: str = "sample_id",
    vec: str = "vec",
    carry: Sequence[str] = ("label",),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Same rows as ``knn_join`` of the queries and the rows in ``cells``, by the metric of its tree."""
    metric = cells.tree.metric
    check_search(k, metric)
    queries = queries.select(query_id, V.as_float(F.col(vec)).alias("vec"))
    n_query, dim = side_size(queries, "vec")
    spark = queries.sparkSession
    n_index = int(cells.coarse[0].sum())
    block_rows = max(1, min(GROUP_ROWS, block_bytes // (4 * max(1, dim))))
    query_rows = max(1, min(block_bytes // (4 * max(1, dim)), max(MIN_QUERY_BLOCK, math.ceil(n_query / parallelism(spark)))))
    group_of = _groups(cells.coarse[0], min(block_rows, math.ceil(n_index / parallelism(spark))))
    shared = spark.sparkContext.broadcast((cells.tree.pivots, *cells.coarse, group_of))
    lists = pa.list_(pa.int32())
    fields = [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("groups", "cells")]

    def visiting(chosen: Iterator[tuple[slice, Sequence[np.ndarray]]]) -> list[pa.Array]:
        """The groups of every row; and the cells that the rows of the batch reach, which its first row names."""
        groups, cells_of = [], set()
        for _, found in chosen:
            for row in found:
                groups.append(np.unique(shared.value[-1][row]).astype(np.int32))
                cells_of.update(row.tolist())
        named = [sorted(cells_of), *[[] for _ in groups[1:]]]
        return [pa.array(groups, type=lists), pa.array(named, type=lists)]

    def near(_: pa.RecordBatch, points: np.ndarray) -> list[pa.Array]:
        pivots, n, _low, _high, _group = shared.value
        return visiting((some, nearest_cells(points[some], pivots, n, k)) for some in _slabs(len(points), len(pivots)))

    unknown = queries.withColumn("__kth", F.lit(None).cast("double"))
    search = (k, query_id, index_id, carry)
    close = materialize(map_vectors(unknown, metric, near, fields))
    first = materialize(best_per_query(_search(close, cells, group_of, *search, _few_cells, block_rows, query_rows), k, metric, query_id, index_id))

    score = score_name(metric)
    kth = first.where(F.col("rank") == k).select(query_id, (-F.col(score) if metric == "l2" else F.col(score)).alias("__kth"))
    bounded = queries.join(kth, query_id, "left").select(query_id, "vec", "__kth")
    at = bounded.columns.index("__kth")

    def open_(batch: pa.RecordBatch, points: np.ndarray) -> list[pa.Array]:
        pivots, n, low, high, _group = shared.value
        reach = np.nan_to_num(batch.column(at).to_numpy(zero_copy_only=False), nan=-np.inf)

        def masks(some: slice) -> list[np.ndarray]:
            mask = reachable_cells(points[some], pivots, low, high, reach[some], metric) & (n > 0)[None, :]
            return [np.flatnonzero(row) for row in mask]

        return visiting((some, masks(some)) for some in _slabs(len(points), len(pivots)))

    def reachable(points: np.ndarray, kth: np.ndarray, _: int, fine: dict[str, np.ndarray]) -> np.ndarray:
        return reachable_cells(points, fine["pivots"], fine["low"], fine["high"], kth, metric)

    # every cell that can matter, those of the first pass included
    wide = materialize(map_vectors(bounded, metric, open_, fields))
    return best_per_query(_search(wide, cells, group_of, *search, reachable, block_rows, query_rows), k, metric, query_id, index_id)


def knn_join_tree(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    metric: str = "cosine",
    *,
    query_id: str = "query_id",
    index_id: str = "sample_id",
    vec: str = "vec",
    carry: Sequence[str] = ("label",),
    cell_rows: int = CELL_ROWS,
    coarse_cells: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Same result as ``knn_join``, for an index of any size."""
    check_search(k, metric)
    rows = index.select(index_id, *carry, V.as_float(F.col(vec)).alias("vec"))
    cells = build_cells(rows, metric, index_id, cell_rows, coarse_cells)
    return search_cells(queries, cells, k, query_id=query_id, index_id=index_id, vec=vec, carry=carry, block_bytes=block_bytes)
