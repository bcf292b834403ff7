"""Classification metrics. One pass counts (truth, prediction) pairs; all else works on those few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.config import CLASS_NAMES


def confusion_counts(df: DataFrame, *keys: str, truth: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def per_class(counts: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall, F1 and support for every label seen as truth or as prediction."""
    sides = counts.select(
        *keys,
        "n",
        F.explode_outer(
            F.array(
                F.struct(F.col("truth").alias("label"), F.lit(1).alias("is_truth")),
                F.struct(F.col("prediction").alias("label"), F.lit(0).alias("is_truth")),
            )
        ).alias("side"),
        (F.col("truth") == F.col("prediction")).alias("hit"),
    ).select(*keys, "n", "hit", "side.*")
    truth, predicted = F.col("is_truth") == 1, F.col("is_truth") == 0
    rows = sides.groupBy(*keys, "label").agg(
        F.sum(F.when(truth & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(truth, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(predicted, F.col("n")).otherwise(0)).alias("predicted"),
    )
    return (
        rows.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")))
    )


def metrics_from_counts(counts: DataFrame, *keys: str) -> DataFrame:
    return per_class(counts, *keys).groupBy(*keys).agg(
        F.sum("support").alias("n"),
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def metrics_summary(df: DataFrame, *keys: str, truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and macro precision, recall, F1, optionally per ``keys``."""
    return metrics_from_counts(confusion_counts(df, *keys, truth=truth, prediction=prediction), *keys)


def confusion_from_counts(counts: DataFrame, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    cells = F.explode_outer(F.array(*[F.lit(c) for c in classes])).alias("truth")
    frame = counts.sparkSession.range(1).select(cells)
    pivoted = counts.groupBy("truth").agg(
        *[F.sum(F.when(F.col("prediction") == c, F.col("n"))).alias(f"predicted_{c}") for c in classes]
    )
    return frame.join(pivoted, "truth", "left").na.fill(0).orderBy("truth")


def confusion_matrix(
    df: DataFrame, classes: tuple[int, ...] = (0, 1), truth: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Fixed class list, rows truth, one column per predicted class, zero where nothing was counted."""
    return confusion_from_counts(confusion_counts(df, truth=truth, prediction=prediction), classes)


def report_from_counts(counts: DataFrame, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    names = counts.sparkSession.range(1).select(
        F.explode_outer(
            F.array(*[F.struct(F.lit(c).alias("label"), F.lit(CLASS_NAMES.get(c, str(c))).alias("entry")) for c in classes])
        ).alias("c")
    ).select("c.*")
    rows = (
        names.join(per_class(counts), "label", "left")
        .select(
            "label",
            "entry",
            *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
            F.coalesce("support", F.lit(0)).alias("support"),
            F.coalesce("tp", F.lit(0)).alias("tp"),
        )
    )
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), n)

    accuracy = _ratio(F.sum("tp"), n)
    summary = rows.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("entry"), accuracy.alias("precision"), accuracy.alias("recall"),
                     accuracy.alias("f1"), n.alias("support")),
            F.struct(F.lit("macro avg").alias("entry"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), n.alias("support")),
            F.struct(F.lit("weighted avg").alias("entry"), weighted("precision").alias("precision"),
                     weighted("recall").alias("recall"), weighted("f1").alias("f1"), n.alias("support")),
        ).alias("s")
    ).select(F.explode_outer("s").alias("s")).select("s.*")
    return rows.select("entry", "precision", "recall", "f1", "support").unionByName(summary)


def classification_report(
    df: DataFrame, classes: tuple[int, ...] = (0, 1), truth: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row per class, then accuracy, macro average and support-weighted average."""
    return report_from_counts(confusion_counts(df, truth=truth, prediction=prediction), classes)


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of several columns in one pass, largest first per column."""
    entry = F.explode_outer(
        F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return (
        df.select(entry.alias("e"))
        .groupBy("e.field", "e.value")
        .agg(F.count("*").alias("n"))
        .orderBy("field", F.desc("n"), "value")
    )
