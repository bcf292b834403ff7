import csv

import pytest
from pyspark.sql import functions as F

from vicinal.catalog import fixtures as X
from vicinal.config import RunConfig
from vicinal.operators.knn import knn_join
from vicinal.operators.vote import majority_vote
from vicinal.session import scratch_path
from vicinal.sources import labelled as CSV
from vicinal.sources import sinks as SK
from vicinal.sources import store as ST
from vicinal.sources.dictionary import feature_names
from vicinal.streaming.score import score_stream


def write(tmp_path, header, rows, name="data.csv"):
    path = tmp_path / name
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


ROWS = [["1", "2.5", "malware"], ["2", "-1e3", "Benign "], ["3", "0", "1"], ["4", "7", "safe"]]


def test_csv(spark, tmp_path):
    data = CSV.load_csv(spark, write(tmp_path, ["a", "b", "y"], ROWS))
    assert data.names == ["a", "b"]
    got = sorted((r["features"], r["label"]) for r in data.rows.collect())
    assert got == [([1.0, 2.5], 1), ([2.0, -1000.0], 0), ([3.0, 0.0], 1), ([4.0, 7.0], 0)]
    assert data.rows.select("sample_id").distinct().count() == 4


def test_named_target_and_sample(spark, tmp_path):
    path = write(tmp_path, ["y", "a", "b"], [[r[2], r[0], r[1]] for r in ROWS])
    data = CSV.load_csv(spark, path, target="y", limit=2, balanced=True)
    assert data.names == ["a", "b"] and sorted(r["label"] for r in data.rows.collect()) == [0, 1]


@pytest.mark.parametrize(
    "header, rows, message",
    [
        (["a", "a", "y"], ROWS, "duplicate"),
        (["y"], [["1"]], "two columns"),
        (["a", "b", "y"], [], "empty_table"),
        (["a", "b", "y"], [*ROWS, ["x", "1", "1"]], "missing_value: 1"),
        (["a", "b", "y"], [*ROWS, ["", "1", "1"]], "missing_value: 1"),
        (["a", "b", "y"], [*ROWS, ["NaN", "1", "1"]], "missing_value: 1"),
        (["a", "b", "y"], [*ROWS, ["-Infinity", "1", "1"]], "infinite_value: 1"),
        (["a", "b", "y"], [*ROWS, ["1", "1", "odd"]], "missing_label: 1"),
        (["a", "b", "y"], [r for r in ROWS if r[2] in ("malware", "1")], "class_0_absent"),
    ],
)
def test_bad_csv(spark, tmp_path, header, rows, message):
    with pytest.raises(ValueError, match=message):
        CSV.load_csv(spark, write(tmp_path, header, rows))


def test_absent_target(spark, tmp_path):
    with pytest.raises(ValueError, match="not found"):
        CSV.load_csv(spark, write(tmp_path, ["a", "b", "y"], ROWS), target="z")


def test_full_width(spark, tmp_path):
    """A table as wide as the dictionary, renamed by position, written, read, searched."""
    width = 2381
    rows = [[str((i * j) % 17) for j in range(1, width + 1)] + [str(i % 2)] for i in range(1, 13)]
    raw = spark.read.csv(write(tmp_path, [f"x{j}" for j in range(width)] + ["class"], rows), header=True)
    path = str(tmp_path / "named")
    CSV.write_csv(CSV.rename_positional(raw, feature_names()), path)
    data = CSV.load_csv(spark, path)
    assert data.names == feature_names()
    index = data.rows.select("sample_id", F.col("features").alias("vec"), "label")
    found = knn_join(index.select(F.col("sample_id").alias("query_id"), "vec"), index, 1)
    assert found.filter("query_id = sample_id").count() == 12


def test_rename_needs_enough_names(spark):
    df = spark.createDataFrame([(1, 2, 0)], "p int, q int, r int")
    assert CSV.rename_positional(df, ["a", "b", "c"]).columns == ["a", "b", "label"]
    with pytest.raises(ValueError):
        CSV.rename_positional(df, ["a"])


def test_vote_sink_keeps_other_modes(spark):
    path = scratch_path(spark, "sink")
    df = spark.createDataFrame([(1, 0)], "prediction int, true_label int")
    SK.write_vote_predictions(SK.vote_predictions(df, "original"), path)
    SK.write_vote_predictions(SK.vote_predictions(df, "embedding"), path)
    SK.write_vote_predictions(SK.vote_predictions(df, "original"), path)
    got = sorted(tuple(r) for r in spark.read.parquet(path).collect())
    assert got == [("malware", "goodware", "PMV", "embedding"), ("malware", "goodware", "PMV", "original")]


def test_index_cache_rules(spark, sf_dir):
    _, index = X.vector_sides(spark, sf_dir)
    path, config = scratch_path(spark, "index"), RunConfig()
    common = dict(names=X.VECTOR_NAMES, config=config)
    assert not ST.index_exists(spark, path)
    assert ST.cached_index(spark, path, "s1", lambda: index, **common)[1]
    assert ST.index_exists(spark, path)
    assert not ST.cached_index(spark, path, "s1", lambda: index, **common)[1]
    assert ST.cached_index(spark, path, "s2", lambda: index, **common)[1]
    assert ST.cached_index(spark, path, "s2", lambda: index, force=True, **common)[1]
    meta = ST.load_index(spark, path)[1]
    assert meta["feature_names"] == X.VECTOR_NAMES and meta["signature"] == "s2"
    with pytest.raises(ValueError, match="mode"):
        ST.load_index(spark, path, "embedding")


def test_broken_build_leaves_the_old_index(spark, sf_dir):
    _, index = X.vector_sides(spark, sf_dir)
    path, config = scratch_path(spark, "index"), RunConfig()
    ST.save_index(index, path, names=X.VECTOR_NAMES, config=config, signature="old")
    broken = index.withColumn("label", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        ST.save_index(broken, path, names=X.VECTOR_NAMES, config=config, signature="new")
    rows, meta = ST.load_index(spark, path)
    assert meta["signature"] == "old" and rows.count() == index.count()


def test_fingerprints_follow_settings(spark, sf_dir):
    parts = ST.file_parts(spark, f"{sf_dir}/embeddings.parquet")
    base = ST.fingerprint(parts, RunConfig(), ["a", "b"])
    assert base == ST.fingerprint(parts, RunConfig(), ["a", "b"])
    changed = dict(
        target_column="y", seed=1, train_limit=5, balance_train=True, cache_version=2, top_k_features=3, feature_order="score", mode="embedding",
        standardize=True, embedding_model="other", embedding_dim=8, top_features_per_row=4, features_per_chunk=2,
    )
    assert set(changed) == set(ST.SHAPING)
    others = [ST.fingerprint(parts, RunConfig(**{k: v}), ["a", "b"]) for k, v in changed.items()]
    others += [
        ST.fingerprint(parts, RunConfig(), ["b", "a"]),
        ST.fingerprint(ST.file_parts(spark, f"{sf_dir}/part.parquet"), RunConfig(), ["a", "b"]),
        ST.fingerprint(parts, RunConfig(), ["a", "b"], scores_only=True),
        ST.fingerprint(parts, RunConfig(), ["a", "b"], classes={0: 1, 1: 2}),
        ST.fingerprint(parts, RunConfig(), ["a", "b"], encoder="mine"),
    ]
    assert len({base, *others}) == len(others) + 1


def test_append_is_repeatable_and_changes_the_fingerprint(spark, sf_dir):
    _, index = X.vector_sides(spark, sf_dir)
    path, config = scratch_path(spark, "index"), RunConfig()
    common = dict(names=X.VECTOR_NAMES, config=config)
    ST.save_index(index.where("sample_id < 100"), path, signature="s", **common)
    first = ST.append_index(index.where("sample_id >= 100"), path, "rest")
    assert first == ST.append_index(index.where("sample_id >= 100"), path, "rest") != "s"
    assert ST.load_index(spark, path)[0].count() == index.count()
    assert not ST.cached_index(spark, path, first, lambda: index, **common)[1]
    assert ST.cached_index(spark, path, "s", lambda: index.limit(7), **common) [1]
    assert ST.load_index(spark, path)[0].count() == 7
    with pytest.raises(ValueError):
        ST.append_index(index, path, "../x")


def test_unfinished_scores_are_not_used(spark):
    root = scratch_path(spark, "scores")
    scores = spark.createDataFrame([("a", 1.0)], "feature string, score double")
    scores.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/signature=s")
    again = ST.cached_scores(spark, root, "s", lambda: scores.withColumn("score", F.lit(2.0)))
    assert again.first()["score"] == 2.0


def test_headers_of_all_files(spark, tmp_path):
    for n, header in enumerate((["id", "a", "b", "label"], ["id", "b", "a", "label"])):
        write(tmp_path, header, [[str(10 * n + i), "1", "2", str(i % 2)] for i in range(4)], f"{n}.csv")
    with pytest.raises(Exception, match="header"):
        CSV.load_csv(spark, str(tmp_path), id_column="id")


def test_numeric_labels(spark, tmp_path):
    rows = [["1", "0.0"], ["2", "1.0"], ["3", "1"]]
    data = CSV.load_csv(spark, write(tmp_path, ["a", "y"], rows))
    assert sorted((r["features"][0], r["label"]) for r in data.rows.collect()) == [(1.0, 0), (2.0, 1), (3.0, 1)]
    with pytest.raises(ValueError, match="label_not_binary: 1"):
        CSV.load_csv(spark, write(tmp_path, ["a", "y"], [*rows, ["4", "2.0"]], "three.csv"))
    with pytest.raises(ValueError, match="missing_label: 2"):  # words: 0.0 and 1.0 are no words for a class
        CSV.load_csv(spark, write(tmp_path, ["a", "y"], [*rows, ["4", "benign"]], "words.csv"))


def test_same_names(spark, tmp_path):
    train = CSV.load_csv(spark, write(tmp_path, ["a", "b", "y"], ROWS, "train.csv"))
    test = CSV.load_csv(spark, write(tmp_path, ["b", "a", "y"], [[r[1], r[0], r[2]] for r in ROWS], "test.csv"))
    fitted = CSV.same_names(train, test)
    assert sorted(r["features"] for r in fitted.rows.collect()) == sorted(r["features"] for r in train.rows.collect())
    with pytest.raises(ValueError, match="missing features"):
        CSV.same_names(train, CSV.LabelledTable(test.rows, ["b", "c"]))


def test_dataset_lengths(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", None)], "sample_id long, text string, label int")
    ST.save_dataset(df, str(tmp_path / "d"))
    with pytest.raises(ValueError, match="different lengths"):
        ST.load_dataset(spark, str(tmp_path / "d"), "text")
    ST.save_dataset(df.na.drop(), str(tmp_path / "e"))
    assert ST.load_dataset(spark, str(tmp_path / "e"), "text").count() == 1


def test_stream_equals_batch_and_repeats_nothing(spark, sf_dir, tmp_path):
    queries, index = X.vector_sides(spark, sf_dir)
    queries = queries.select("query_id", "vec")
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    queries.repartition(3).write.parquet(source)

    def run():
        stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(source)
        score_stream(stream, index, 3, sink, state).awaitTermination()
        return sorted(spark.read.parquet(sink).drop("batch").collect())

    want = sorted(majority_vote(knn_join(queries, index, 3)).collect())
    assert run() == want
    assert run() == want  # nothing new has arrived


def test_a_stream_of_a_table_in_a_folder_or_a_file(spark, sf_dir, tmp_path):
    whole = X.table(spark, sf_dir, "embeddings")
    whole.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    for number, folder in enumerate((str(tmp_path), sf_dir)):
        sink, state = str(tmp_path / f"sink{number}"), str(tmp_path / f"state{number}")
        stream = X.arriving(spark, folder, "embeddings").writeStream.format("parquet").option("path", sink)
        stream.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(sink).count() == whole.count()
