import pytest
from pyspark.sql import functions as F

from vicinal.catalog import fixtures as X
from vicinal.catalog.queries import letter_encoder, majority_reader
from vicinal.config import RunConfig
from vicinal.operators.mutual_info import mutual_info
from vicinal.operators.search import nearest
from vicinal.plans.classify import choose_features, vote_classification
from vicinal.plans.fused import fused_classification
from vicinal.plans.sweep import sweep_k
from vicinal.plans.text_index import build_text_index, search_text_index


@pytest.fixture(scope="module")
def split(spark, sf_dir):
    return X.vector_split(spark, sf_dir)


def test_model_that_follows_the_vote(split):
    train, test = split
    out = fused_classification(train, test, X.VECTOR_NAMES, RunConfig(), make_generator=majority_reader)
    assert len(out.columns) == 25
    rows = out.select("prediction", "mv_prediction", "decision_source", "llm_unanimous").distinct().collect()
    assert all(r["prediction"] == r["mv_prediction"] for r in rows)
    assert {(r["decision_source"], r["llm_unanimous"]) for r in rows} == {("llm_agrees_with_mv", True)}


def test_answers_or_model(split):
    with pytest.raises(ValueError):
        fused_classification(*split, X.VECTOR_NAMES, RunConfig())


def test_too_many_neighbors(split):
    with pytest.raises(ValueError, match="training rows"):
        vote_classification(*split, X.VECTOR_NAMES, RunConfig(k=401))


def test_standardised_run(split):
    out = vote_classification(*split, X.VECTOR_NAMES, RunConfig(standardize=True, k=5))
    assert out.count() == 100 and out.filter("votes_0 + votes_1 <> 5").count() == 0


def test_embedding_run_with_a_model(split):
    config = RunConfig(mode="embedding", top_features_per_row=16)
    assert vote_classification(*split, X.VECTOR_NAMES, config, make_encoder=letter_encoder).count() == 100


def test_feature_choice(split):
    train, _ = split
    scores = mutual_info(train, X.VECTOR_NAMES)
    assert choose_features(train, X.VECTOR_NAMES, RunConfig()) == X.VECTOR_NAMES
    ordered = choose_features(train, X.VECTOR_NAMES, RunConfig(feature_order="score"), scores)
    assert sorted(ordered) == sorted(X.VECTOR_NAMES) and ordered != X.VECTOR_NAMES
    assert choose_features(train, X.VECTOR_NAMES, RunConfig(top_k_features=5), scores) == ordered[:5]


def test_sweep_equals_single_runs(spark, sf_dir, split):
    queries, index = X.vector_sides(spark, sf_dir)
    truth = queries.select("query_id", "true_label")
    swept = {r["k"]: r["accuracy"] for r in sweep_k(nearest(queries, index, 5), truth, [1, 2, 5]).collect()}
    for k, accuracy in swept.items():
        out = vote_classification(*split, X.VECTOR_NAMES, RunConfig(k=k))
        assert out.agg(F.avg((F.col("prediction") == F.col("true_label")).cast("double"))).first()[0] == pytest.approx(accuracy)


def test_text_index(spark):
    rows = [(10, "red green", 0), (20, "red green blue", 1), (30, "one two three", 0)]
    index = build_text_index(spark.createDataFrame(rows, "sample_id long, text string, label int"))
    queries = index.filter("sample_id = 10").select(F.col("sample_id").alias("query_id"), "vec")
    found = search_text_index(queries, index, 2).orderBy("rank").collect()
    assert [(r["sample_id"], r["text"], r["label"]) for r in found] == [(10, "red green", 0), (20, "red green blue", 1)]
    assert found[0]["distance"] == 0


@pytest.mark.parametrize(
    "settings",
    [dict(k=0), dict(mode="raw"), dict(top_k_features=0), dict(features_per_chunk=0), dict(min_features=0), dict(max_features=2)],
)
def test_bad_settings(settings):
    with pytest.raises(ValueError):
        RunConfig(**settings).check()
