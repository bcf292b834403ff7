"""Feature ranking, selection and standardisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions.vectors import pick_positions
from vicinal.operators.validate import finite, require_features


def rank_features(scores: DataFrame) -> DataFrame:
    """(rank, feature, score), best first; ties by name. One row per feature."""
    best = Window.orderBy(F.desc("score"), "feature")
    return scores.select(F.row_number().over(best).alias("rank"), "feature", "score")


def best_features(scores: DataFrame, top_k: int) -> DataFrame:
    if top_k <= 0:
        raise ValueError("top_k must be greater than zero")
    return scores.orderBy(F.desc("score"), "feature").limit(top_k)


def selected_names(scores: DataFrame, names: Sequence[str], top_k: int | None, order: str = "file") -> list[str]:
    """Names to keep, in order. As many rows as the table has columns reach the driver."""
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be greater than zero")
    if top_k is None or top_k >= len(names):
        if order == "file":
            return list(names)
        top_k = len(names)
    return [r["feature"] for r in best_features(scores, top_k).collect()]


def select_features(df: DataFrame, names: Sequence[str], wanted: Sequence[str], features: str = "features") -> DataFrame:
    """Keep the wanted features of the array column, in the wanted order."""
    require_features(wanted, names)
    if list(names) == list(wanted):
        return df
    at = {name: i for i, name in enumerate(names)}
    return df.withColumn(features, pick_positions(F.col(features), [at[n] for n in wanted]))


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature position."""

    means: list[float]
    stds: list[float]


def fit_scaler(df: DataFrame, features: str = "features") -> Scaler:
    """Two numbers per feature come back to the driver, however many rows there are."""
    stats = (
        df.select(F.posexplode_outer(finite(F.col(features))).alias("pos", "value"))
        .groupBy("pos")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
        .orderBy("pos")
        .collect()
    )
    return Scaler([r["mean"] for r in stats], [r["std"] for r in stats])


def standardize(df: DataFrame, scaler: Scaler, features: str = "features") -> DataFrame:
    """Z-scores with fitted statistics; a constant feature is only centred."""
    width = F.assert_true(F.size(features) == len(scaler.means), F.lit("vector length differs from the fitted one"))
    values = F.when(width.isNull(), F.col(features))
    centred = F.zip_with(values, F.lit(scaler.means), lambda x, m: x - m)
    return df.withColumn(
        features, F.zip_with(centred, F.lit([s if s > 0 else 1.0 for s in scaler.stds]), lambda x, s: x / s)
    )
