import pytest
from pyspark.sql import functions as F

from vicinal.operators import labels as L
from vicinal.operators import validate as VD
from vicinal.operators.features import best_features, fit_scaler, select_features, selected_names, standardize
from vicinal.operators.sample import sample_rows


@pytest.mark.parametrize(
    "raw, want",
    [(" MALWARE ", 1), ("Benign", 0), ("true", 1), ("0", 0), ("1.0", None), ("unknown", None), (None, None), ("", None)],
)
def test_label_words(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert L.normalise_labels(df, "raw").first()["label"] == want


def test_label_numbers_and_booleans(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.7,)], "raw double")
    assert [r["label"] for r in L.normalise_labels(df, "raw").collect()] == [0, 1, None]
    assert [r["label"] for r in L.normalise_labels(df, "raw", strict=False).collect()] == [0, 1, 0]
    flags = spark.createDataFrame([(True,), (False,)], "raw boolean")
    assert [r["label"] for r in L.normalise_labels(flags, "raw").collect()] == [1, 0]


def good(spark):
    rows = [(i, [float(i), 1.0], i % 2) for i in range(6)]
    return spark.createDataFrame(rows, "sample_id long, features array<double>, label int")


def test_good_table_passes(spark):
    VD.require(VD.validation_report(good(spark), 2))


@pytest.mark.parametrize(
    "features, label, check",
    [
        ("array(1D, null)", "label", "missing_value"),
        ("array(1D, double('NaN'))", "label", "missing_value"),
        ("array(double('Infinity'), 1D)", "label", "infinite_value"),
        ("array(double('-Infinity'), 1D)", "label", "infinite_value"),
        ("array(1D)", "label", "wrong_length"),
        ("features", "null", "missing_label"),
        ("features", "2", "label_not_binary"),
    ],
)
def test_each_violation_raises(spark, features, label, check):
    bad = F.col("sample_id") == 3
    df = good(spark).select(
        "sample_id",
        F.when(bad, F.expr(features)).otherwise(F.col("features")).alias("features"),
        F.when(bad, F.expr(label)).otherwise(F.col("label")).alias("label"),
    )
    with pytest.raises(ValueError, match=rf"{check}: 1 \(first: 3\)"):
        VD.require(VD.validation_report(df, 2))


def test_one_class_and_empty_raise(spark):
    with pytest.raises(ValueError, match="class_1_absent"):
        VD.require(VD.validation_report(good(spark).filter("label = 0"), 2))
    with pytest.raises(ValueError, match="empty_table"):
        VD.require(VD.validation_report(good(spark).filter("sample_id > 99"), 2))
    with pytest.raises(ValueError):
        VD.require_two_classes(good(spark).filter("label = 1"))


def test_validation_is_one_pass(spark):
    plan = VD.validation_report(good(spark), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_blank_text(spark):
    df = good(spark).withColumn("text", F.when(F.col("sample_id") == 2, " ").otherwise("x"))
    with pytest.raises(ValueError, match="blank_text"):
        VD.require(VD.validation_report(df, 2, text="text"))


def test_features_by_name(spark):
    out = select_features(good(spark), ["a", "b"], ["b", "a"]).orderBy("sample_id").collect()
    assert out[4]["features"] == [1.0, 4.0]
    with pytest.raises(ValueError, match="missing features"):
        select_features(good(spark), ["a", "b"], ["c"])


def test_choice_and_order_of_features(spark):
    scores = spark.createDataFrame([("b", 0.5), ("c", 0.5), ("a", 0.9), ("d", 0.1)], "feature string, score double")
    names = ["d", "c", "b", "a"]
    assert selected_names(scores, names, 3) == ["a", "b", "c"]
    assert selected_names(scores, names, None) == names
    assert selected_names(scores, names, 10) == names
    assert selected_names(scores, names, None, "score") == ["a", "b", "c", "d"]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            selected_names(scores, names, bad)
        with pytest.raises(ValueError):
            best_features(scores, bad)


def test_constant_feature_is_only_centred(spark):
    df = good(spark)
    rows = standardize(df, fit_scaler(df)).collect()
    assert {r["features"][1] for r in rows} == {0.0}
    assert sum(r["features"][0] for r in rows) == pytest.approx(0)


def population(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("sample_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))


def test_uniform_sample(spark):
    df = population(spark)
    ids = {r["sample_id"] for r in sample_rows(df, 701, 42).collect()}
    assert len(ids) == 701
    assert ids == {r["sample_id"] for r in sample_rows(df.repartition(7), 701, 42).collect()}
    assert ids != {r["sample_id"] for r in sample_rows(df, 701, 43).collect()}
    assert sample_rows(df, 10**9, 42).count() == 3000
    assert sample_rows(df, None, 42) is df
    smaller = {r["sample_id"] for r in sample_rows(df, 50, 42).collect()}
    assert smaller < ids  # the smallest keys


def test_sample_equals_global_sort(spark):
    df = population(spark, 500)
    want = df.orderBy(F.md5(F.concat(F.lit("1:"), "sample_id")), "sample_id").limit(123).select("sample_id")
    assert sorted(want.collect()) == sorted(sample_rows(df, 123, 1).select("sample_id").collect())


@pytest.mark.parametrize("limit, each", [(None, 300), (200, 100), (201, 100), (10**6, 300)])
def test_balanced_sample(spark, limit, each):
    counts = sample_rows(population(spark), limit, 42, balanced=True).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in counts} == {0: each, 1: each}


def test_impossible_samples(spark):
    with pytest.raises(ValueError):
        sample_rows(population(spark), 1, 42)
    with pytest.raises(ValueError):
        sample_rows(population(spark), 1, 42, balanced=True)
    with pytest.raises(ValueError):
        sample_rows(population(spark).filter("label = 0"), None, 42, balanced=True)


def test_scores_and_scaler_refuse_what_is_not_finite(spark):
    from vicinal.operators.features import fit_scaler
    from vicinal.operators.mutual_info import mutual_info, mutual_info_binned

    good = [([float(i), float(i % 3)], i % 2) for i in range(20)]
    for bad in ([float("nan"), 1.0], [None, 1.0], [float("inf"), 1.0], None):
        df = spark.createDataFrame([*good, (bad, 1)], "features array<double>, label int")
        for run in (lambda: mutual_info(df, ["a", "b"]).collect(), lambda: mutual_info_binned(df, ["a", "b"]).collect(), lambda: fit_scaler(df)):
            with pytest.raises(Exception, match="null, NaN or infinite"):
                run()


def test_scaler_length(spark):
    from vicinal.operators.features import Scaler, standardize

    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "features array<double>")
    with pytest.raises(Exception, match="length"):
        standardize(df, Scaler([0.0, 0.0], [1.0, 1.0])).collect()


def test_class_sizes(spark):
    from vicinal.operators import labels as L

    assert L.class_sizes(spark.createDataFrame([(0,), (1,), (1,)], "label int")) == {0: 1, 1: 2}
    with pytest.raises(ValueError, match="no class label"):
        L.class_sizes(spark.range(L.MOST_CLASSES + 1).withColumnRenamed("id", "label"))
