"""Exact-size, seeded random samples without a global sort.

Rows get a random-looking key from the seed and their id; a sample is the rows with the smallest keys.
Instead of sorting everything, one aggregate counts rows per key prefix. It tells which prefixes are
wholly inside, and only the one prefix at the edge is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 4  # 16**4 prefixes: the edge holds about 1/65536 of the rows


def order_key(seed: int, id_col: str) -> Column:
    """Seeded order of the rows; also the shuffled order of a sample."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _prefix_counts(keyed: DataFrame, group: str | None) -> DataFrame:
    keys = ["prefix"] if group is None else [group, "prefix"]
    return keyed.groupBy(*keys).agg(F.count("*").alias("n"))


def _edges(counts: DataFrame, group: str | None, sizes: dict) -> list[dict]:
    """Per group: the edge prefix and how many rows are still wanted from it."""
    by_group = [] if group is None else [group]
    running = Window.partitionBy(*by_group).orderBy("prefix")
    cumulative = counts.withColumn("upto", F.sum("n").over(running))
    edges = []
    for value, size in sizes.items():
        part = cumulative if group is None else cumulative.filter(F.col(group) == value)
        row = part.filter((F.col("upto") >= size) & (F.col("upto") - F.col("n") < size)).first()
        edges.append({"value": value, "prefix": row["prefix"], "rest": size - (row["upto"] - row["n"])})
    return edges


def _take(keyed: DataFrame, edges: list[dict], group: str | None, id_col: str) -> DataFrame:
    prefix = F.col("prefix")
    inside, edge, rest = F.lit(False), F.lit(False), F.lit(0)
    for e in edges:
        here = F.lit(True) if group is None else F.col(group) == e["value"]
        inside = inside | (here & (prefix < e["prefix"]))
        edge = edge | (here & (prefix == e["prefix"]))
        rest = F.when(here, F.lit(e["rest"])).otherwise(rest)
    window = Window.partitionBy(*([] if group is None else [group]), "prefix").orderBy("sample_order", id_col)
    ranked = keyed.filter(edge).withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= rest)
    return keyed.filter(inside).unionByName(ranked.drop("__rank")).drop("prefix")


def sample_rows(
    df: DataFrame,
    limit: int | None,
    seed: int,
    balanced: bool = False,
    *,
    id_col: str = "sample_id",
    label: str = "label",
) -> DataFrame:
    """Uniform or class-balanced sample; adds ``sample_order``, the shuffled order of the rows.

    Uniform: ``min(limit, rows)`` rows, at least two. Balanced: per class the same number of rows, at
    most the smaller class and at most ``limit // 2``. Without limit and balance the table is returned.
    """
    if limit is None and not balanced:
        return df
    key = order_key(seed, id_col)
    keyed = df.withColumn("sample_order", key).withColumn("prefix", F.substring("sample_order", 1, PREFIX_DIGITS))
    group = label if balanced else None
    counts = _prefix_counts(keyed, group).cache()
    try:
        if balanced:
            sums = counts.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.sum("n").alias("n"))
            totals = {r[label]: r["n"] for r in sums.collect()}
            size = min(totals.get(0, 0), totals.get(1, 0))
            if limit is not None:
                size = min(size, int(limit) // 2)
            if size <= 0:
                raise ValueError("a balanced sample is not possible")
            sizes = {0: size, 1: size}
        else:
            size = min(int(limit), counts.agg(F.sum("n")).first()[0] or 0)
            if size < 2:
                raise ValueError("the sample must contain at least two rows")
            sizes = {None: size}
        edges = _edges(counts, group, sizes)
    finally:
        counts.unpersist()
    return _take(keyed, edges, group, id_col)
