"""Whole runs from files: load, compare names, reuse scores and index, predict, write, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vicinal.config import RunConfig
from vicinal.operators.embed import Encoder
from vicinal.operators.metrics import classification_report
from vicinal.operators.mutual_info import mutual_info
from vicinal.operators.search import nearest
from vicinal.operators.vote import majority_vote
from vicinal.plans.classify import as_queries, prepare, require_neighbors, with_vectors
from vicinal.plans.fused import fused_from_sides
from vicinal.session import stored
from vicinal.sources.labelled import LabelledTable, load_csv, same_names
from vicinal.sources.sinks import vote_predictions, write_fused_predictions, write_vote_predictions
from vicinal.sources.store import cached_index, cached_scores, file_parts, fingerprint


@dataclass(frozen=True)
class Sides:
    """What a run compares: an index of training rows, the queries, and the features both are made of."""

    index: DataFrame
    queries: DataFrame
    names: list[str]
    rebuilt: bool


def load_sides(spark: SparkSession, train_path: str, test_path: str, config: RunConfig, id_column: str | None = None) -> tuple[LabelledTable, LabelledTable]:
    """Both files, checked and sampled by the settings; the test side has the training side's features in its order."""
    train = load_csv(spark, train_path, config.target_column, config.train_limit, config.seed, config.balance_train, id_column)
    test = load_csv(spark, test_path, config.target_column, config.test_limit, config.seed, config.balance_test, id_column)
    return train, same_names(train, test)


def open_sides(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    config: RunConfig,
    store: str,
    *,
    id_column: str | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
    encoder: str = "",
    force: bool = False,
) -> Sides:
    """Scores and index are taken from ``store`` where their fingerprints agree. ``encoder`` names the caller's model."""
    if (make_encoder is None) != (encoder == ""):
        raise ValueError("a caller's encoder needs a name, and only it has one")
    train, test = load_sides(spark, train_path, test_path, config, id_column)
    files = file_parts(spark, train_path)
    scores = None
    if config.feature_order == "score" or (config.top_k_features or len(train.names)) < len(train.names):
        key = fingerprint(files, config, train.names, scores_only=True)
        scores = cached_scores(spark, f"{store}/scores", key, lambda: mutual_info(train.rows, train.names))
    left, right, chosen = prepare(train.rows, test.rows, train.names, config, scores)
    key = fingerprint(files, config, chosen, encoder=encoder)
    index, rebuilt = cached_index(
        spark, f"{store}/index-{config.mode}", key, lambda: with_vectors(left, chosen, config, make_encoder),
        names=chosen, config=config, force=force,
    )
    require_neighbors(index, config.k)
    return Sides(index, as_queries(with_vectors(right, chosen, config, make_encoder)), chosen, rebuilt)


def run_vote(spark: SparkSession, train_path: str, test_path: str, config: RunConfig, store: str, out: str, **options) -> tuple[DataFrame, DataFrame]:
    """(votes, report). Predictions are written below ``out``, one folder per retrieval mode."""
    sides = open_sides(spark, train_path, test_path, config, store, **options)
    votes = majority_vote(nearest(sides.queries, sides.index, config.k))
    votes = stored(votes.join(sides.queries.select("query_id", "true_label"), "query_id"), "votes")
    write_vote_predictions(vote_predictions(votes, config.mode, keep=("query_id",)), out)
    return votes, classification_report(votes, truth="true_label")


def run_fused(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    config: RunConfig,
    store: str,
    out: str,
    *,
    id_column: str | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
    encoder: str = "",
    force: bool = False,
    **model,
) -> DataFrame:
    """Full result rows. Predictions are written to ``out`` as CSV. ``model`` as for ``fused_classification``."""
    sides = open_sides(spark, train_path, test_path, config, store, id_column=id_column, make_encoder=make_encoder, encoder=encoder, force=force)
    results = stored(fused_from_sides(sides.index, sides.queries, sides.names, config, **model), "results")
    write_fused_predictions(results, out)
    return results
