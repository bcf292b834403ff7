import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import text as X
from vicinal.functions import vectors as V
from vicinal.operators import embed as E
from vicinal.sources.dictionary import FEATURE_COUNT, feature_descriptions, feature_dim, feature_names


@pytest.mark.parametrize("digits", [3, 4])
def test_numbers_are_formatted_like_ieee_formatting(spark, digits):
    rng = np.random.default_rng(1)
    ties = np.arange(-400, 400) / 32
    values = np.concatenate([ties, rng.normal(size=800), rng.normal(size=200) * 1e-5, rng.normal(size=200) * 1e5])
    values = [float(np.float32(v)) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for signed in (True, False):
        got = [r[0] for r in df.select(X.fixed(F.col("v"), digits, signed)).collect()]
        want = [f"{v:{'+' if signed else ''}.{digits}f}" for v in values]
        assert got == want


def one(spark, values):
    return spark.createDataFrame([(1, values)], "sample_id long, features array<double>")


def test_top_abs(spark):
    df = one(spark, [1.0, -5.0, 0.5, 5.0, -2.0])

    def places(n):
        return [(e["pos"], e["value"]) for e in df.select(X.top_abs(F.col("features"), n).alias("t")).first()["t"]]

    assert places(3) == [(1, -5.0), (3, 5.0), (4, -2.0)]
    assert places(1) == [(1, -5.0)]  # ties go to the smaller position
    assert [p for p, _ in places(9)] == [0, 1, 2, 3, 4]


def test_chunks(spark):
    chunks = [r["chunk"] for r in E.row_chunks(one(spark, [0.5, -1.0, 2.0]), ["a", "b", "c"], per_chunk=2).orderBy("chunk_no").collect()]
    assert chunks == [
        "Windows PE static features. a has standardized value +0.5000; b has standardized value -1.0000.",
        "Windows PE static features. c has standardized value +2.0000.",
    ]


def test_display(spark):
    labels = X.display_labels(["a", "b"], {"a": "first"})
    df = one(spark, [0.0625, -1.0])
    got = df.select(X.display_items(F.col("features"), labels, 20).alias("i")).first()["i"]
    assert got == ["a (first)=+0.062", "b (b)=-1.000"]
    assert df.select(X.display_items(F.col("features"), labels, 1).alias("i")).first()["i"] == ["a (first)=+0.062"]


def test_token_count(spark):
    df = spark.createDataFrame([("a b-c, (d)=+0.5",), ("",)], "t string")
    assert [r[0] for r in df.select(X.token_count(F.col("t"))).collect()] == [13, 0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(
        V.l2_normalize(F.col("a")).alias("unit"), V.l2_normalize(F.col("b")).alias("zero"),
        V.cosine(F.col("a"), F.col("b")).alias("cosine"), V.squared_distance(F.col("a"), F.col("b")).alias("l2"),
        V.mean_abs_distance(F.col("a"), F.col("b")).alias("mad"),
    ).first()
    assert (row["unit"], row["zero"], row["cosine"], row["l2"], row["mad"]) == ([0.6, 0.8], [0.0, 0.0], 0.0, 25.0, 3.5)


def test_dictionary(spark):
    names = feature_names()
    assert len(names) == len(set(names)) == FEATURE_COUNT == 2381
    rows = feature_dim(spark).orderBy("pos").collect()
    assert [r["name"] for r in rows] == names
    assert {r["name"]: r["description"] for r in rows} == feature_descriptions()
    assert rows[10]["description"] == "relative frequency of byte 0x0A"
    assert rows[-1]["description"] == "PE data-directory feature 29"


def test_hashing_embedder(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, " \n"), (3, "b\ta a")], "id long, text string")
    got = {r["id"]: r["vec"] for r in E.embed_hashing(df, "text", ["id"], 16).collect()}
    assert got[1] == got[3] and got[2] == [0.0] * 16
    assert np.linalg.norm(got[1]) == pytest.approx(1)


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vec array<double>")
    assert E.mean_pool(df, "id").first()["vec"] == pytest.approx([0.5**0.5] * 2)
    opposite = spark.createDataFrame([(1, [1.0, 0.0]), (1, [-1.0, 0.0])], "id long, vec array<double>")
    with pytest.raises(Exception, match="no direction"):
        E.mean_pool(opposite, "id").collect()


def test_caller_model(spark):
    def counting():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    def flat():
        return lambda texts: np.ones(len(texts))

    def broken():
        return lambda texts: np.full((len(texts), 2), np.nan)

    df = spark.createDataFrame([(1, "abc"), (2, "x")], "id long, text string")
    got = {r["id"]: r["vec"] for r in E.embed_with(df, "text", counting, batch_rows=1).collect()}
    assert got[1] == pytest.approx(list(np.array([3, 1]) / 10**0.5))
    for model, message in ((flat, "wrong shape"), (broken, "NaN")):
        with pytest.raises(Exception, match=message):
            E.embed_with(df, "text", model).collect()
    with pytest.raises(Exception, match="blank"):
        E.embed_with(df.withColumn("text", F.lit(" ")), "text", counting).collect()
    with pytest.raises(ValueError):
        E.embed_with(df, "text", counting, batch_rows=0)
