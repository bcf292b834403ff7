import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators.blocks import best_in_block, surplus_copies
from vicinal.operators.knn import best_per_query, grid_shape, knn_join, knn_single
from vicinal.operators.pruned import knn_join_pruned
from vicinal.operators.search import nearest
from vicinal.operators.vote import majority_vote


def brute(q, x, ids, k, metric):
    """(query, id, score) by direct evaluation in double precision."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    out = []
    for i, a in enumerate(q):
        if metric == "l2":
            s = -np.square(x - a).sum(axis=1)
        else:
            s = (x * a).sum(axis=1)
            if metric == "cosine":
                scale = np.sqrt(np.square(x).sum(axis=1)) * np.sqrt(np.square(a).sum())
                s = np.divide(s, scale, out=np.zeros_like(s), where=scale > 0)
        order = np.lexsort((ids, -np.round(s, 10)))[:k]
        out += [(i, int(ids[j]), round(float(s[j]), 6)) for j in order]
    return out


def clustered(rows, dim, seed, hot=0.35):
    """Clusters plus one vector that makes up a third of all rows, a zero vector and scaled copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 4
    m = (centres[rng.integers(0, 6, rows)] + rng.normal(size=(rows, dim)) * 0.2).astype(np.float32)
    m[rng.random(rows) < hot] = m[0]
    m[1] = 0
    m[2] = m[3] * 2
    return m


def frame(spark, m, name):
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(m)]
    return spark.createDataFrame(rows, f"{name} long, vec array<float>, label int")


def as_rows(df, metric):
    score = "distance" if metric == "l2" else "similarity"
    sign = -1 if metric == "l2" else 1
    return [
        (r["query_id"], r["sample_id"], round(sign * r[score], 6) + 0.0)
        for r in df.orderBy("query_id", "rank").collect()
    ]


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_block_kernel_equals_brute_force(metric):
    q, x = clustered(40, 7, 1), clustered(300, 7, 2)
    ids = np.random.default_rng(3).permutation(300)
    rows, cols, scores = best_in_block(q, x, ids, 5, metric)
    got = [(int(r), int(ids[c]), round(float(s), 6) + 0.0) for r, c, s in zip(rows, cols, scores)]
    assert got == [(i, j, s + 0.0) for i, j, s in brute(q, x, ids, 5, metric)]


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_grid_and_pruned_equal_brute_force(spark, metric):
    q, x = clustered(60, 5, 4), clustered(400, 5, 5)
    queries, index = frame(spark, q, "query_id"), frame(spark, x, "sample_id")
    want = [(i, j, s + 0.0) for i, j, s in brute(q, x, np.arange(400), 4, metric)]
    assert as_rows(knn_join(queries, index, 4, metric), metric) == want
    assert as_rows(knn_join(queries, index, 4, metric, grid=(3, 5)), metric) == want
    pruned = knn_join_pruned(queries, index, 4, metric, cells=12, block_bytes=1000)
    assert as_rows(pruned, metric) == want
    assert as_rows(nearest(queries, index, 4, metric, prune=True), metric) == want


def test_pruning_skips_cells():
    from vicinal.operators.blocks import distances, reachable_cells

    m = clustered(500, 5, 6, hot=0).astype(np.float64)
    pivots = m[10:40]
    d = distances(m, pivots)
    cell = d.argmin(axis=1)
    low = np.array([d[cell == c, c].min(initial=0) for c in range(30)])
    high = np.array([d[cell == c, c].max(initial=0) for c in range(30)])
    kth = np.array([-np.sort(np.square(m - a).sum(axis=1))[3] for a in m])
    assert reachable_cells(m, pivots, low, high, kth, "l2").mean() < 0.6


def test_surplus_copies_keep_the_smallest_ids():
    m = np.array([[1, 1]] * 5 + [[2, 2]] * 2, dtype=np.float32)
    ids = np.array([9, 3, 7, 1, 5, 8, 2])
    assert sorted(ids[surplus_copies(ids, m, 2)]) == [1, 2, 3, 8]


def test_shorter_lists_are_prefixes_and_k_is_capped(spark):
    x = clustered(30, 4, 7)
    queries, index = frame(spark, x[:5], "query_id"), frame(spark, x, "sample_id")
    nine = as_rows(knn_join(queries, index, 9), "cosine")
    three = as_rows(knn_join(queries, index, 3), "cosine")
    assert three == [r for i in range(5) for r in nine[i * 9 : i * 9 + 3]]
    assert len(as_rows(knn_join(queries, index, 100), "cosine")) == 5 * 30
    assert len(as_rows(knn_join_pruned(queries, index, 100, cells=4), "cosine")) == 5 * 30


def test_scaling_keeps_cosine_neighbours(spark):
    x = clustered(50, 4, 8, hot=0)
    queries, index = frame(spark, x[5:9], "query_id"), frame(spark, x[4:], "sample_id")
    bigger = index.withColumn("vec", F.transform("vec", lambda v: v * 8))
    assert as_rows(knn_join(queries, index, 3), "cosine") == as_rows(knn_join(queries, bigger, 3), "cosine")


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_single_query_equals_join(spark, metric):
    x = clustered(80, 4, 9, hot=0)
    index = frame(spark, x, "sample_id")
    one = knn_single(index, x[7], 5, metric).collect()
    joined = knn_join(frame(spark, x[7:8], "query_id"), index, 5, metric).orderBy("rank").collect()
    assert [r["sample_id"] for r in one] == [r["sample_id"] for r in joined]


@pytest.mark.parametrize("bad", [[1.0], [1.0, float("nan")], [1.0, float("inf")], None])
def test_malformed_vectors_raise(spark, bad):
    index = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, bad, 1)], "sample_id long, vec array<float>, label int")
    queries = spark.createDataFrame([(0, [1.0, 2.0])], "query_id long, vec array<float>")
    with pytest.raises(Exception, match="vector|value"):
        knn_join(queries, index, 1, grid=(1, 1)).collect()


def test_guards(spark):
    df = spark.createDataFrame([(0, [1.0])], "query_id long, vec array<float>")
    with pytest.raises(ValueError):
        knn_join(df, df, 0)
    with pytest.raises(ValueError):
        knn_join(df, df, 1, "hamming")


def test_grid_shape():
    assert grid_shape(100, 400, 64, 8) == (1, 1)
    assert grid_shape(27035, 134435, 256, 8) == (3, 13)
    q, i = grid_shape(27035, 134435, 2381, 1000)
    assert q * i >= 4000 and 27035 / q > 256 and 134435 / i > 1024
    assert grid_shape(10**9, 10**9, 1000, 8) == (59605, 59605)  # no smaller than the block size asks for
    assert grid_shape(0, 10, 4, 8) == (1, 1)


def test_vote_tie_goes_to_the_nearest(spark):
    rows = [(1, 1, 1), (1, 2, 0), (2, 1, 0), (2, 2, 1), (3, 1, 1), (3, 2, 0), (3, 3, 0)]
    df = spark.createDataFrame(rows, "query_id long, rank int, label int")
    got = {r["query_id"]: (r["prediction"], r["margin"]) for r in majority_vote(df).collect()}
    assert got == {1: (1, 0), 2: (0, 0), 3: (0, 1)}


def test_merge_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "query_id long, sample_id long, similarity double")
    plan = best_per_query(df, 3, "cosine", "query_id", "sample_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1


@pytest.mark.parametrize("vector", [[1.0, 2.0], [1.0, float("nan"), 2.0], [1.0, 2.0, 3.0, 4.0]])
def test_single_query_must_fit(spark, vector):
    from vicinal.operators.knn import knn_single

    index = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], "sample_id long, vec array<double>, label int")
    with pytest.raises(Exception, match="length|NaN"):
        knn_single(index, vector, 1).collect()


def test_one_class_training_is_refused(spark):
    from vicinal.config import RunConfig
    from vicinal.plans.classify import vote_classification

    rows = spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(6)], "sample_id long, features array<double>, label int")
    with pytest.raises(ValueError, match="both classes"):
        vote_classification(rows, rows, ["a", "b"], RunConfig())


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_few_queries_travel_to_the_index(spark, sf_dir, metric):
    from vicinal.catalog import fixtures as X
    from vicinal.operators.knn import knn_few, knn_join
    from vicinal.operators.search import nearest

    queries, index = X.vector_sides(spark, sf_dir)
    want = sorted(map(tuple, knn_join(queries, index, 4, metric).collect()))
    found = knn_few(queries, index, 4, metric, block_bytes=5000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(query_id" in plan[: plan.index("MapInArrow")]
    assert "Exchange hashpartitioning" not in plan[plan.index("MapInArrow") :]
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, nearest(queries, index, 4, metric).collect())) == want
    assert sorted(map(tuple, nearest(queries, index, 4, metric, prune=True).collect())) == want


def test_embedding_stays_in_the_row(spark, sf_dir):
    from vicinal.catalog import fixtures as X
    from vicinal.operators.embed import embed_rows

    plan = embed_rows(X.vectors(spark, sf_dir), X.VECTOR_NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_one_long_row_does_not_slow_the_rest(metric):
    import time

    import numpy as np

    from vicinal.operators.blocks import best_in_block

    rng = np.random.default_rng(3)
    q, x = (rng.normal(size=(n, 64)).astype(np.float32) for n in (256, 20_000))
    ids = np.arange(len(x))

    def run(index):
        start = time.perf_counter()
        rows, cols, _ = best_in_block(q, index, ids, 3, metric)
        return time.perf_counter() - start, rows, cols

    run(x)
    plain = min(run(x)[0] for _ in range(3))
    far = x.copy()
    far[777] = 1e6
    slow, rows, cols = min((run(far) for _ in range(3)), key=lambda r: r[0])
    assert slow < 3 * plain + 0.1
    exact = {"l2": -np.square(q[:, None].astype(float) - far[None, :400].astype(float)).sum(2), "ip": q.astype(float) @ far[:400].astype(float).T}
    if metric in exact:  # spot check on a small block, scored in full
        rows, cols, _ = best_in_block(q, far[:400], ids[:400], 3, metric)
        want = np.argsort(-exact[metric], axis=1, kind="stable")[:, :3]
        assert (cols.reshape(-1, 3) == want).all()


@pytest.mark.parametrize("dim", [1, 2, 5, 8])
def test_few_columns_are_searched_by_box(dim):
    from vicinal.operators.blocks import BOX_ROWS, nearest_in_boxes

    rng = np.random.default_rng(dim)
    x = np.round(rng.normal(size=(5 * BOX_ROWS, dim)) * 50).astype(np.float32)  # full of ties
    x[: BOX_ROWS + 9] = x[0]
    q, ids = np.concatenate([x[::9], rng.normal(size=(90, dim)).astype(np.float32)]), rng.permutation(len(x))
    rows, cols, scores = nearest_in_boxes(q, x, ids, 4)
    got = sorted((int(r), int(ids[c]), round(float(s), 6) + 0.0) for r, c, s in zip(rows, cols, scores))
    assert got == sorted((i, j, s + 0.0) for i, j, s in brute(q, x, ids, 4, "l2"))


def test_few_columns_take_time_in_proportion():
    """All pairs of these rows take several times as long."""
    import time

    from vicinal.operators.blocks import best_in_block

    x = np.random.default_rng(1).normal(size=(100_000, 2)).astype(np.float32)
    begin = time.monotonic()
    assert len(best_in_block(x, x, np.arange(len(x)), 3, "l2")[0]) == 3 * len(x)
    assert time.monotonic() - begin < 20


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
@pytest.mark.parametrize("dim, k", [(9, 4), (64, 700)])
def test_wide_rows_in_tiles_equal_brute_force(metric, dim, k):
    from vicinal.operators import blocks

    q, x = clustered(blocks.TILE_QUERIES + 60, dim, 7), clustered(2 * blocks.SORTED_TILES * blocks.TILE_ROWS, dim, 8)
    q[::3] = np.round(x[100 : 100 + len(q[::3])])
    x[500:900] = np.round(x[500:900])  # full of ties
    x[901] = 1e4
    ids = np.random.default_rng(9).permutation(len(x))
    rows, cols, scores = best_in_block(q, x, ids, k, metric)
    assert (np.bincount(rows) == k).all() and (np.diff(rows) >= 0).all()
    some = np.arange(0, len(q), 40)
    scored = blocks.exact_scores(metric, np.repeat(q[some], len(x), axis=0), np.tile(x, (len(some), 1))).reshape(len(some), -1)
    for row, s in zip(some, scored):
        want = np.lexsort((ids, -s))[:k]
        assert (ids[cols[rows == row]] == ids[want]).all() and (scores[rows == row] == s[want]).all()


def test_wide_rows_leave_out_tiles_that_are_too_far():
    """All pairs of these rows take several times as long."""
    import time

    rng = np.random.default_rng(2)
    centres = np.column_stack([rng.normal(size=(200, 4)), np.zeros((200, 60))])
    x = (centres[rng.integers(0, 200, 60_000)] + rng.normal(size=(60_000, 64)) * 0.01).astype(np.float32)
    begin = time.monotonic()
    assert len(best_in_block(x, x, np.arange(len(x)), 3, "l2")[0]) == 3 * len(x)
    assert time.monotonic() - begin < 10
