"""Metrics for many settings from one neighbour search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.config import RunConfig
from vicinal.operators.features import fit_scaler, rank_features, select_features, standardize
from vicinal.operators.metrics import metrics_summary
from vicinal.operators.mutual_info import mutual_info
from vicinal.operators.prefixes import prefix_join
from vicinal.operators.search import nearest
from vicinal.operators.validate import require_two_classes
from vicinal.operators.vote import vote_columns, vote_prediction
from vicinal.plans.classify import as_queries, prepare, with_vectors
from vicinal.session import materialize


def sweep_k(neighbors: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row of metrics per k. The first k of a longer neighbour list are the neighbours for k.

    ``neighbors`` has at least max(ks) ranks; ``truth`` is (query_id, true_label).
    """
    wanted = F.explode(F.filter(F.lit(sorted(ks)), lambda k: k >= F.col("rank")))
    votes = (
        neighbors.select("query_id", "rank", "label", wanted.alias("k"))
        .groupBy("query_id", "k")
        .agg(*vote_columns(F.col("label"), F.col("rank")))
        .withColumn("prediction", vote_prediction())
    )
    return metrics_summary(votes.join(truth, "query_id"), "k", truth="true_label")


def sweep_settings(
    train: DataFrame, test: DataFrame, names: Sequence[str], configs: Sequence[RunConfig], ks: Sequence[int]
) -> DataFrame:
    """(mode, top_k_features, k, metrics): one neighbour search per setting, all k from each.

    Feature scores are the same for every setting and computed once. ``top_k_features`` is the number of
    features a run used.
    """
    cuts = any(c.top_k_features is not None and c.top_k_features < len(names) for c in configs)
    scores = materialize(mutual_info(train, names)) if cuts else None
    parts = []
    for config in configs:
        left, right, chosen = prepare(train, test, names, config, scores)
        index = with_vectors(left, chosen, config)
        queries = as_queries(with_vectors(right, chosen, config))
        found = nearest(queries, index, max(ks))
        metrics = sweep_k(found, queries.select("query_id", "true_label"), ks)
        parts.append(
            metrics.select(F.lit(config.mode).alias("mode"), F.lit(len(chosen)).alias("top_k_features"), *metrics.columns)
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def sweep_prefixes(
    train: DataFrame,
    test: DataFrame,
    names: Sequence[str],
    tops: Sequence[int | None],
    ks: Sequence[int],
    config: RunConfig = RunConfig(),
    scores: DataFrame | None = None,
) -> DataFrame:
    """(top_k_features, k, metrics) for the best features of every size in ``tops`` (None: all) and every k.

    The features are put in score order once, so the best 128 are the first 128 columns, and one search over the index
    serves all sizes. Settings other than ``top_k_features`` and ``k`` hold for all; only mode "original" has features to cut.
    """
    config.check()
    if config.mode != "original":
        raise ValueError("texts are written from chosen features: sweep them with sweep_settings")
    if not ks or min(ks) <= 0:
        raise ValueError("k must be greater than zero")
    require_two_classes(train)
    scores = materialize(mutual_info(train, names)) if scores is None else scores
    order = [r["feature"] for r in rank_features(scores).orderBy("rank").collect()]
    prefixes = sorted({min(len(names), len(names) if top is None else top) for top in tops})
    chosen = order[: prefixes[-1]] if prefixes else []
    train, test = select_features(train, names, chosen), select_features(test, names, chosen)
    if config.standardize:
        scaler = fit_scaler(train)
        train, test = standardize(train, scaler), standardize(test, scaler)
    found = prefix_join(
        test.select(F.col("sample_id").alias("query_id"), F.col("features").alias("vec")),
        train.select("sample_id", F.col("features").alias("vec"), "label"),
        max(ks), prefixes,
    )
    wanted = F.explode(F.filter(F.lit(sorted(set(ks))), lambda k: k >= F.col("rank")))
    votes = (
        found.select("query_id", "prefix", "rank", "label", wanted.alias("k"))
        .groupBy("query_id", "prefix", "k")
        .agg(*vote_columns(F.col("label"), F.col("rank")))
        .withColumn("prediction", vote_prediction())
        .withColumnRenamed("prefix", "top_k_features")
    )
    truth = test.select(F.col("sample_id").alias("query_id"), F.col("label").alias("true_label"))
    return metrics_summary(votes.join(truth, "query_id"), "top_k_features", "k", truth="true_label")
