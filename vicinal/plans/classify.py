"""Label rows by a vote of their nearest training rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.config import RunConfig
from vicinal.operators.distinct_texts import embed_rows_distinct
from vicinal.operators.embed import Encoder, embed_rows
from vicinal.operators.features import fit_scaler, select_features, selected_names, standardize
from vicinal.operators.mutual_info import mutual_info
from vicinal.operators.search import nearest
from vicinal.operators.validate import require_two_classes
from vicinal.operators.vote import majority_vote
from vicinal.session import stored


def choose_features(
    train: DataFrame, names: Sequence[str], config: RunConfig, scores: DataFrame | None = None
) -> list[str]:
    """Feature names to use, in order. Scores are computed only if the choice depends on them."""
    cuts = config.top_k_features is not None and config.top_k_features < len(names)
    if not cuts and config.feature_order == "file":
        return list(names)
    if scores is None:
        scores = mutual_info(train, names)
    return selected_names(scores, names, config.top_k_features, config.feature_order)


def prepare(
    train: DataFrame, test: DataFrame, names: Sequence[str], config: RunConfig, scores: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the chosen features, standardised with training statistics if asked for."""
    config.check()
    require_two_classes(train)
    chosen = choose_features(train, names, config, scores)
    train, test = select_features(train, names, chosen), select_features(test, names, chosen)
    if config.standardize:
        scaler = fit_scaler(train)
        train, test = standardize(train, scaler), standardize(test, scaler)
    return train, test, chosen


def with_vectors(
    df: DataFrame, names: Sequence[str], config: RunConfig, make_encoder: Callable[[], Encoder] | None = None
) -> DataFrame:
    """(sample_id, vec, raw, label). ``raw`` are the features, ``vec`` what is compared."""
    columns = ["sample_id", F.col("features").cast("array<float>").alias("raw"), "label"]
    if config.mode == "original":
        return df.select(*columns).withColumn("vec", F.col("raw"))
    shape = dict(keep=columns, top_features=config.top_features_per_row, per_chunk=config.features_per_chunk)
    if make_encoder is not None:  # a model is dearer than the shuffle that spares it repeated texts
        vectors = embed_rows_distinct(df, names, make_encoder, **shape)
    else:
        vectors = embed_rows(df, names, dim=config.embedding_dim, **shape)
    # text vectors are expensive, and sizing, search and reuse all read them
    return stored(vectors, "vectors")


def as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        F.col("sample_id").alias("query_id"), "vec", "raw", F.col("label").alias("true_label")
    )


def require_neighbors(index: DataFrame, k: int) -> None:
    """Every query needs k neighbours, so the training side must have that many rows."""
    if index.count() < k:
        raise ValueError("k exceeds the number of training rows")


def vote_classification(
    train: DataFrame,
    test: DataFrame,
    names: Sequence[str],
    config: RunConfig,
    *,
    scores: DataFrame | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """(query_id, prediction, true_label, votes_0, votes_1, nearest_label, margin) per test row.

    ``train`` and ``test`` are (sample_id, features, label) with the feature order of ``names``.
    """
    train, test, chosen = prepare(train, test, names, config, scores)
    index = with_vectors(train, chosen, config, make_encoder)
    require_neighbors(index, config.k)
    queries = as_queries(with_vectors(test, chosen, config, make_encoder))
    votes = majority_vote(nearest(queries, index, config.k))
    return votes.join(queries.select("query_id", "true_label"), "query_id")
