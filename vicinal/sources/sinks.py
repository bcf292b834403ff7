"""Prediction tables and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.labels import label_name

# Fixed value: type of a prediction made by the vote alone.
VOTE_TYPE = "PMV"


def vote_predictions(df: DataFrame, mode: str, *, truth: str = "true_label", keep: tuple[str, ...] = ()) -> DataFrame:
    """prediction, true_label, pred_type, retrieval_mode."""
    return df.select(
        *keep,
        label_name(F.col("prediction")).alias("prediction"),
        label_name(F.col(truth)).alias("true_label"),
        F.lit(VOTE_TYPE).alias("pred_type"),
        F.lit(mode).alias("retrieval_mode"),
    )


def write_vote_predictions(predictions: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per retrieval mode; writing one mode again leaves the others alone."""
    writer = predictions.write.mode("overwrite").partitionBy("retrieval_mode")
    writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.option("header", "true").format(fmt).save(path)


def fused_predictions(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return results.select(*keep, "prediction", "true_label", "pred_type")


def write_fused_predictions(results: DataFrame, path: str) -> None:
    fused_predictions(results).write.mode("overwrite").csv(path, header=True)
