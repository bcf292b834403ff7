import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators.mutual_info import mutual_info, mutual_info_binned, running_total


def psi(x):
    x = np.asarray(x, float)
    y = x + 6
    i = 1 / (y * y)
    series = i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))
    return np.log(y) - 0.5 / y - series - sum(1 / (x + s) for s in range(6))


def brute(x, y, kk=3):
    keep = np.array([np.sum(y == c) > 1 for c in y])
    x, y = x[keep], y[keep]
    total = 0.0
    for a, c in zip(x, y):
        own = np.abs(x[y == c] - a)
        use = min(kk, len(own) - 1)
        r = np.sort(own)[use]
        inside = np.abs(x - a) < r * (1 - 1e-9) - 1e-15 * abs(a)  # rows at the radius do not count
        near, m = (np.sum(own == 0), np.sum(x == a)) if r == 0 else (use, np.sum(inside))
        total += psi(near) - psi(m) - psi(len(own))
    return max(0.0, float(psi(len(x)) + total / len(x)))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 300
    y = rng.integers(0, 2, n)
    y[0] = 7  # a class with one row
    x = np.column_stack(
        [
            rng.normal(size=n) + 2 * (y == 1),
            np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n)),  # one value holds 40 %
            rng.integers(0, 4, n) + 0.0,
            np.round(rng.normal(size=n), 1),
            np.zeros(n),
        ]
    )
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "sample_id long, features array<double>, label int")


NAMES = ["normal", "spiked", "small", "rounded", "constant"]


@pytest.mark.parametrize("run_rows", [2_000_000, 60])
def test_equals_brute_force(data, run_rows):
    x, y, df = data
    got = {r["feature"]: r["score"] for r in mutual_info(df, NAMES, run_rows=run_rows).collect()}
    for j, name in enumerate(NAMES):
        assert got[name] == pytest.approx(brute(x[:, j], y), abs=1e-9), name


def test_binned_is_the_same_in_runs(data):
    _, _, df = data
    whole = {r["feature"]: r["score"] for r in mutual_info_binned(df, NAMES).collect()}
    runs = {r["feature"]: r["score"] for r in mutual_info_binned(df, NAMES, run_rows=70).collect()}
    assert whole == pytest.approx(runs)
    assert whole["constant"] == 0 and whole["normal"] > 0.1


def test_running_total_over_runs(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    one = {(r["g"], r["v"]): r["t"] for r in running_total(df, ["g"], ["v"], F.col("v"), "t").collect()}
    many = {(r["g"], r["v"]): r["t"] for r in running_total(df, ["g"], ["v"], F.col("v"), "t", runs=13).collect()}
    assert one == many


def test_no_class_with_two_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 1)], "sample_id long, features array<double>, label int")
    with pytest.raises(ValueError):
        mutual_info(df, ["a"])


def test_short_runs_share_tasks(spark):
    """A task per run sent the driver more the shorter the runs were."""
    rows = spark.range(3000).selectExpr("array(double(id * 7 % 997), double(id % 50)) AS features", "int(id % 3 = 0) AS label")
    context = spark.sparkContext
    context.setJobGroup("runs", "features in short runs")
    scores = {r.feature: r.score for r in mutual_info(rows, ["a", "b"], run_rows=5).collect()}
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("runs") for s in tracker.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert scores == pytest.approx({r.feature: r.score for r in mutual_info(rows, ["a", "b"]).collect()})
    assert max(s.numTasks for s in stages if s) <= 200  # there are 1200 runs
