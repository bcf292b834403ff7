"""Prefix search, pivot trees and stored cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_knn import as_rows, brute, clustered, frame

from vicinal.operators import tree as TR
from vicinal.operators.knn import knn_join
from vicinal.operators.prefixes import best_by_prefix, prefix_join
from vicinal.plans.sweep import sweep_prefixes
from vicinal.sources.cells import append_cells, cells_exist, open_cells, save_cells
from vicinal.sources.store import index_meta


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_prefixes_equal_one_search_each(metric):
    q, x = clustered(40, 9, 1), clustered(300, 9, 2)
    q[5, :4] = 0  # no direction in the short prefixes
    if metric == "cosine":
        x[7, :2] = 1e-25
    ids = np.random.default_rng(3).permutation(300)
    for prefix, rows, cols, scores in best_by_prefix(q, x, ids, 5, [2, 4, 9], metric):
        got = [(int(r), int(ids[c]), round(float(s), 6) + 0.0) for r, c, s in zip(rows, cols, scores)]
        assert got == [(i, j, s + 0.0) for i, j, s in brute(q[:, :prefix], x[:, :prefix], ids, 5, metric)]


@pytest.mark.parametrize("few_bytes", [0, 1 << 20])
def test_prefix_join_on_both_ways(spark, few_bytes):
    q, x = clustered(60, 6, 4), clustered(400, 6, 5)
    queries, index = frame(spark, q, "query_id"), frame(spark, x, "sample_id")
    found = prefix_join(queries, index, 4, [6, 3, 3], few_bytes=few_bytes)
    for prefix in (3, 6):
        part = F.slice("vec", 1, prefix).alias("vec")
        want = knn_join(queries.select("query_id", part), index.select("sample_id", part, "label"), 4)
        assert as_rows(found.where(F.col("prefix") == prefix), "cosine") == as_rows(want, "cosine")
    with pytest.raises(ValueError):
        prefix_join(queries, index, 4, [7])
    with pytest.raises(ValueError):
        prefix_join(queries, index, 4, [])


def test_prefix_join_scans_the_index_once(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS sample_id", "embedding AS vec", "label")
    queries = rows.where("sample_id % 7 = 0").selectExpr("sample_id AS query_id", "vec")
    plan = prefix_join(queries, rows, 3, [8, 64])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_sweep_of_nothing_is_refused(spark):
    rows = frame(spark, clustered(30, 3, 1), "sample_id").withColumnRenamed("vec", "features")
    with pytest.raises(ValueError):
        sweep_prefixes(rows, rows, ["a", "b", "c"], [2], [])
    with pytest.raises(ValueError):
        sweep_prefixes(rows, rows, ["a", "b", "c"], [0], [3])
    out = sweep_prefixes(rows, rows, ["a", "b", "c"], [2, None, 99], [1, 3]).collect()
    assert sorted((r.top_k_features, r.k) for r in out) == [(2, 1), (2, 3), (3, 1), (3, 3)]


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_tree_equals_brute_force(spark, metric):
    q, x = clustered(60, 5, 4), clustered(400, 5, 5)
    queries, index = frame(spark, q, "query_id"), frame(spark, x, "sample_id")
    want = [(i, j, s + 0.0) for i, j, s in brute(q, x, np.arange(400), 4, metric)]
    got = TR.knn_join_tree(queries, index, 4, metric, cell_rows=8, coarse_cells=5, block_bytes=1000)
    assert as_rows(got, metric) == want


def test_tree_with_few_rows(spark):
    x = clustered(30, 4, 7)
    queries, index = frame(spark, x[:5], "query_id"), frame(spark, x, "sample_id")
    assert len(as_rows(TR.knn_join_tree(queries, index, 100, cell_rows=4), "cosine")) == 5 * 30
    with pytest.raises(ValueError):
        TR.knn_join_tree(queries, index.limit(0), 3)
    assert TR.knn_join_tree(queries.limit(0), index, 3, cell_rows=4).count() == 0


def test_a_search_without_structure_writes_no_row_per_fine_cell(spark, monkeypatch):
    kept, keep = [], TR.materialize
    monkeypatch.setattr(TR, "materialize", lambda df: kept.append(keep(df)) or kept[-1])
    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(100, 12)).astype(np.float32), rng.normal(size=(1500, 12)).astype(np.float32)
    got = TR.knn_join_tree(frame(spark, q, "query_id"), frame(spark, x, "sample_id"), 3, "l2", cell_rows=4)
    assert as_rows(got, "l2") == [(i, j, s + 0.0) for i, j, s in brute(q, x, np.arange(1500), 3, "l2")]
    assert kept and max(df.count() for df in kept) <= 100 * 3  # there are about 400 fine cells


def test_cells_keep_their_size_when_the_index_grows(spark):
    largest = []
    for rows in (1500, 4500):
        index = frame(spark, clustered(rows, 4, 11, hot=0), "sample_id")
        cells = TR.build_cells(index, "l2", cell_rows=32)
        counts = [r["n"] for r in cells.bounds.collect()]
        assert sum(counts) == rows
        largest.append(max(counts))
    assert largest[1] <= 1.5 * largest[0]


def test_a_hot_coarse_cell_is_cut_into_chunks(spark):
    """A third of all rows in one cell: the rows that meet its pivots are spread over many tasks."""
    index = frame(spark, clustered(600, 5, 3), "sample_id")
    cells = TR.build_cells(index, "cosine", cell_rows=16)
    schema = cells.rows.select("sample_id").schema.add("rows", "integer")

    def count(own, fine):
        import pyarrow as pa

        return pa.table({"sample_id": own["sample_id"], "rows": pa.array([own.num_rows] * own.num_rows, pa.int32())})

    found = TR._with_fine(cells.rows.drop("fine"), cells.tree.fine, "sample_id", count, schema, block_bytes=20 * 4 * 5, dim=5)
    assert found.count() == 600 and found.agg(F.max("rows")).first()[0] < 60


@pytest.fixture()
def stored_cells(spark, tmp_path):
    x = clustered(500, 5, 5, hot=0.1)
    index = frame(spark, x, "sample_id")
    path = str(tmp_path / "index")
    save_cells(index.where("sample_id < 300"), path, signature="s", metric="l2", cell_rows=8, coarse_cells=12)
    return x, index, path


def test_appended_cells_widen_bounds(spark, stored_cells):
    x, index, path = stored_cells
    assert cells_exist(spark, path)
    for _ in range(2):  # a batch that is sent twice is stored once
        signature = append_cells(index.where("sample_id >= 300"), path, "late")
    meta = index_meta(spark, path)
    assert meta["signature"] == signature != "s" and meta["batches"] == ["first", "late"]
    queries = frame(spark, clustered(30, 5, 4), "query_id")
    cells, _ = open_cells(spark, path)
    want = [(i, j, s + 0.0) for i, j, s in brute(clustered(30, 5, 4), x, np.arange(500), 4, "l2")]
    assert as_rows(TR.search_cells(queries, cells, 4), "l2") == want
    first, _ = open_cells(spark, path, ["first"])
    want = [(i, j, s + 0.0) for i, j, s in brute(clustered(30, 5, 4), x[:300], np.arange(300), 4, "l2")]
    assert as_rows(TR.search_cells(queries, first, 4), "l2") == want
    append_cells(index.limit(0), path, "none")  # a batch without rows
    assert open_cells(spark, path)[0].rows.count() == 500
    with pytest.raises(ValueError):
        append_cells(index, path, "first")


def test_a_search_reads_only_reachable_partitions(spark, stored_cells):
    x, _, path = stored_cells
    cells, _ = open_cells(spark, path)
    queries = frame(spark, x[40:42], "query_id")
    plan = TR.search_cells(queries, cells, 2)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "sample_id" in line]
    assert scans and all("PartitionFilters" in s and "coarse" in s.split("PartitionFilters")[1] for s in scans)
    visits = spark.createDataFrame([(1, 0)], "coarse int, fine int")
    few = TR.reached(cells.rows, visits)
    files = [df.select(F.input_file_name().alias("f")).distinct().collect() for df in (few, cells.rows)]
    assert files[0] and all("/coarse=1/" in r.f for r in files[0]) and len(files[0]) < len(files[1])
    assert TR.reached(cells.rows, visits.limit(0)).count() == 0


def test_another_layout_is_refused(spark, tmp_path, stored_cells):
    from vicinal.config import RunConfig
    from vicinal.sources.store import save_index

    _, index, _ = stored_cells
    path = str(tmp_path / "flat")
    save_index(index.withColumn("raw", F.col("vec")), path, names=["a"], config=RunConfig(), signature="s")
    assert not cells_exist(spark, path) and not cells_exist(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        open_cells(spark, path)
