"""Equal-frequency bins from summaries of bounded size: feature scores without a long form of the data.

A summary holds levels of at most ``size`` values; a value on level l stands for 2^l rows. A full level is sorted and every
other value of it moves up, alternately the odd and the even ones. Each such step moves a rank by at most 2^l, and level l is
full at most n / (size 2^l) times, so a rank is wrong by at most n h / size, where h is the number of levels above the first,
about log2(n / size). Up to ``size`` rows nothing moves up and ranks are exact. Summaries are merged level by level under
the same bound, whatever the order.

Tasks summarise the values of their rows where they lie. Summaries travel, rows do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.mutual_info import scores_of_bins
from vicinal.operators.validate import finite

SIZE = 512
SALTS = 64
"""groups in which the summaries of a feature are merged before they meet"""
SUMMARY = "pos int, level int, odd boolean, points array<double>"


class Summary:
    """Levels of values of one feature; the value of a point on level l counts 2^l times."""

    def __init__(self, size: int):
        self.size, self.levels, self.odd = size, [], []

    def add(self, values: np.ndarray, level: int = 0, odd: bool = False) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.zeros(0))
            self.odd.append(False)
        self.levels[level] = np.concatenate([self.levels[level], values])
        self.odd[level] ^= odd
        while level < len(self.levels) and len(self.levels[level]) > self.size:
            # pairs of neighbours become one; what is left over stays
            full = np.sort(self.levels[level])
            even = len(full) // 2 * 2
            self.levels[level] = full[even:]
            moved = full[:even][int(self.odd[level]) :: 2]
            self.odd[level] = not self.odd[level]
            level += 1
            if level == len(self.levels):
                self.levels.append(np.zeros(0))
                self.odd.append(False)
            self.levels[level] = np.concatenate([self.levels[level], moved])

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """(values ascending, rows that each stands for)."""
        values = np.concatenate([np.zeros(0), *self.levels])
        weights = np.repeat(1 << np.arange(len(self.levels), dtype=np.int64), [len(v) for v in self.levels])
        order = np.argsort(values, kind="stable")
        return values[order], weights[order]

    def edges(self, bins: int) -> np.ndarray:
        """Smallest value of bin 1, 2, ...: the first with at least b / bins of all rows below it, or infinity."""
        values, weights = self.weighted()
        values, first = np.unique(values, return_index=True)
        below = np.concatenate([[0], np.cumsum(weights)])[first]
        wanted = np.arange(1, bins) * weights.sum()
        at = np.searchsorted(below * bins, wanted, "left")
        return np.append(values, math.inf)[at]


def rank_error(n: int, size: int = SIZE) -> float:
    """Bound on how far a rank among ``n`` rows can be off. Merging leaves at most one level more than one pass over all rows."""
    return 0.0 if n <= size else n * (math.ceil(math.log2(n / size)) + 1) / size


def _rows(summaries: dict[int, Summary]) -> pa.RecordBatch:
    flat = [(pos, level, one.odd[level], points) for pos, one in sorted(summaries.items()) for level, points in enumerate(one.levels)]
    columns = [pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[3] for r in flat], pa.list_(pa.float64()))], names=["pos", "level", "odd", "points"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width:
        raise ValueError(f"vectors must have {width} components")
    return flat.reshape(len(column), width) + 0.0  # turns a negative zero into zero


def summarise(df: DataFrame, width: int, features: str = "features", size: int = SIZE) -> DataFrame:
    """(pos, level, odd, points): one summary per feature. Tasks', then groups of them, then all are merged."""
    if size < 2:
        raise ValueError("a summary needs room for two values")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {pos: Summary(size) for pos in range(width)}
        for batch in batches:
            matrix = _matrix(batch.column("v"), width)
            for pos, one in held.items():
                one.add(matrix[:, pos])
        yield _rows(held)

    def merge(table: pa.Table) -> pa.Table:
        one = Summary(size)
        order = sorted(zip(table["level"].to_pylist(), table["odd"].to_pylist(), range(table.num_rows)), key=lambda r: r[0])
        for level, odd, row in order:
            one.add(np.array(table["points"][row].as_py(), np.float64), level, odd)
        return pa.Table.from_batches([_rows({table["pos"][0].as_py(): one})])

    each = df.select(finite(F.col(features)).alias("v")).mapInArrow(scan, SUMMARY)
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    some = each.withColumn("salt", salt).groupBy("pos", "salt").applyInArrow(lambda t: merge(t), SUMMARY)
    return some.groupBy("pos").applyInArrow(lambda t: merge(t), SUMMARY)


def bin_edges(df: DataFrame, width: int, bins: int, features: str = "features", size: int = SIZE) -> tuple[np.ndarray, int]:
    """(features x (bins - 1) edges, number of rows). As many numbers reach the driver."""

    def close(table: pa.Table) -> pa.Table:
        one = Summary(size)
        for level, points in zip(table["level"].to_pylist(), table["points"].to_pylist()):
            while len(one.levels) <= level:
                one.levels.append(np.zeros(0))
            one.levels[level] = np.array(points, np.float64)
        edges = pa.array([one.edges(bins)], pa.list_(pa.float64()))
        return pa.table({"pos": table["pos"][:1], "n": pa.array([int(one.weighted()[1].sum())]), "edges": edges})

    found = summarise(df, width, features, size).groupBy("pos").applyInArrow(lambda t: close(t), "pos int, n long, edges array<double>")
    rows = sorted(found.collect())
    return np.array([r["edges"] for r in rows]).reshape(width, bins - 1), rows[0]["n"] if rows else 0


def count_bins(df: DataFrame, edges: np.ndarray, features: str = "features", label: str = "label") -> DataFrame:
    """(pos, bin, y, c). A task counts its rows and sends one number per cell."""
    width, bins = edges.shape[0], edges.shape[1] + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            matrix, classes = _matrix(batch.column("v"), width), batch.column("y").to_numpy(zero_copy_only=False)
            at = np.stack([np.searchsorted(edges[pos], matrix[:, pos], "right") for pos in range(width)], axis=1) + np.arange(width) * bins
            for y in np.unique(classes).tolist():
                cells = np.bincount(at[classes == y].ravel(), minlength=width * bins)
                total[y] = total.get(y, 0) + cells
        for y, cells in total.items():
            used = np.flatnonzero(cells)
            columns = [(used // bins).astype(np.int32), (used % bins).astype(np.int32), np.full(len(used), y, np.int32), cells[used]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pos", "bin", "y", "c"])

    rows = df.select(finite(F.col(features)).alias("v"), F.col(label).cast("int").alias("y"))
    return rows.mapInArrow(scan, "pos int, bin int, y int, c long").groupBy("pos", "bin", "y").agg(F.sum("c").alias("c"))


def mutual_info_sketched(
    df: DataFrame, names: Sequence[str], bins: int = 10, *, features: str = "features", label: str = "label", size: int = SIZE
) -> DataFrame:
    """(feature, score): ``mutual_info_binned`` with bins whose ranks are off by at most ``rank_error``, in two scans.

    Equal values share a bin. Labels must be there and be numbers; an empty table is refused.
    """
    if bins < 2:
        raise ValueError("at least two bins are needed")
    edges, n = bin_edges(df, len(names), bins, features, size)
    if not n:
        raise ValueError("no rows")
    return scores_of_bins(count_bins(df, edges, features, label), names, n)
