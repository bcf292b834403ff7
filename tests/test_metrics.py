"""Published confusion matrices must give the published metrics."""

import pytest
from pyspark.sql import functions as F

from vicinal.operators import metrics as M

# (true 0 predicted 0, true 0 predicted 1, true 1 predicted 0, true 1 predicted 1), accuracy, P, R, F1
PUBLISHED = [
    ((12930, 564, 4955, 8586), (0.7959, 0.8307, 0.7961, 0.7904)),
    ((12888, 606, 4993, 8548), (0.7929, 0.8273, 0.7932, 0.7874)),
    ((12880, 614, 4939, 8602), (0.7946, 0.8281, 0.7949, 0.7893)),
    ((12853, 641, 4914, 8627), (0.7945, 0.8271, 0.7948, 0.7894)),
    ((12956, 538, 5072, 8469), (0.7925, 0.8295, 0.7928, 0.7866)),
    ((10653, 2841, 6105, 7436), (0.6691, 0.6796, 0.6693, 0.6643)),
    ((12449, 1045, 7752, 5789), (0.6746, 0.7317, 0.6750, 0.6536)),
    ((12948, 546, 4946, 8595), (0.7969, 0.8319, 0.7971, 0.7914)),
    ((12941, 553, 4772, 8769), (0.8030, 0.8356, 0.8033, 0.7982)),
    ((12916, 578, 4637, 8904), (0.8071, 0.8374, 0.8074, 0.8028)),
    ((12902, 592, 4594, 8947), (0.8082, 0.8377, 0.8084, 0.8040)),
    ((12696, 798, 5616, 7925), (0.7628, 0.8009, 0.7631, 0.7551)),
    ((12583, 911, 5368, 8173), (0.7677, 0.8003, 0.7680, 0.7614)),
    ((12550, 944, 5326, 8215), (0.7681, 0.7995, 0.7684, 0.7620)),
    ((12540, 954, 5307, 8234), (0.7684, 0.7994, 0.7687, 0.7624)),
    ((13320, 174, 5618, 7923), (0.7858, 0.8409, 0.7861, 0.7769)),
    ((13268, 226, 5576, 7965), (0.7854, 0.8383, 0.7857, 0.7768)),
    ((13268, 226, 5481, 8060), (0.7889, 0.8402, 0.7892, 0.7808)),
    ((13277, 217, 5545, 7996), (0.7869, 0.8395, 0.7872, 0.7784)),
    ((13186, 308, 4286, 9255), (0.8301, 0.8612, 0.8303, 0.8264)),
    ((13171, 323, 6357, 7184), (0.7529, 0.8157, 0.7533, 0.7402)),
    ((13130, 364, 7348, 6193), (0.7147, 0.7928, 0.7152, 0.6946)),
]
CELLS = [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_published_metrics(spark):
    rows = [(run, t, p, n) for run, (cm, _) in enumerate(PUBLISHED) for (t, p), n in zip(CELLS, cm)]
    counts = spark.createDataFrame(rows, "run int, truth int, prediction int, n long")
    got = {r["run"]: r for r in M.metrics_from_counts(counts, "run").collect()}
    for run, (_, want) in enumerate(PUBLISHED):
        r = got[run]
        have = (r["accuracy"], r["macro_precision"], r["macro_recall"], r["macro_f1"])
        assert [round(x, 4) for x in have] == list(want)


def test_report_as_published(spark):
    counts = spark.createDataFrame([(t, p, n) for (t, p), n in zip(CELLS, PUBLISHED[15][0])], "truth int, prediction int, n long")
    got = {r["entry"]: r for r in M.report_from_counts(counts).collect()}
    want = {"goodware": (0.70, 0.99, 0.82, 13494), "malware": (0.98, 0.59, 0.73, 13541), "weighted avg": (0.84, 0.79, 0.78, 27035)}
    for entry, values in want.items():
        r = got[entry]
        assert (round(r["precision"], 2), round(r["recall"], 2), round(r["f1"], 2), r["support"]) == values


@pytest.mark.parametrize("prediction, wanted", [(0, (0.5, 0.25, 0.5)), (1, (0.5, 0.25, 0.5))])
def test_zero_division_is_zero(spark, prediction, wanted):
    df = spark.createDataFrame([(0, prediction), (1, prediction)], "label int, prediction int")
    r = M.metrics_summary(df).first()
    assert (r["accuracy"], r["macro_precision"], r["macro_recall"]) == wanted


def test_confusion_matrix_keeps_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    assert [tuple(r) for r in M.confusion_matrix(df).collect()] == [(0, 2, 0), (1, 0, 0)]


def test_distributions(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "a string, b int")
    got = [tuple(r) for r in M.distributions(df.withColumn("b", F.col("b")), ["a", "b"]).collect()]
    assert got == [("a", "x", 2), ("a", "y", 1), ("b", "1", 2), ("b", "2", 1)]
