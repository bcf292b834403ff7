"""Majority vote over retrieved neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vote_columns(label: Column, rank: Column) -> list[Column]:
    """Aggregates of one query's neighbours that decide the vote."""
    return [
        F.count_if(label == 0).alias("votes_0"),
        F.count_if(label == 1).alias("votes_1"),
        F.min_by(label, rank).alias("nearest_label"),
    ]


def vote_prediction() -> Column:
    """Larger count; on a tie the label of the nearest neighbour."""
    return (
        F.when(F.col("votes_0") > F.col("votes_1"), F.lit(0))
        .when(F.col("votes_1") > F.col("votes_0"), F.lit(1))
        .otherwise(F.col("nearest_label"))
    )


def majority_vote(neighbors: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, votes_0, votes_1, nearest_label, prediction, margin)."""
    return (
        neighbors.groupBy(query_id)
        .agg(*vote_columns(F.col("label"), F.col("rank")))
        .withColumn("prediction", vote_prediction())
        .withColumn("margin", F.abs(F.col("votes_0") - F.col("votes_1")))
    )


def neighbor_lists(neighbors: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Labels and similarities per query in rank order. At most k entries per query."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "label", "similarity")))
    return (
        neighbors.groupBy(query_id)
        .agg(ordered.alias("__n"))
        .select(
            query_id,
            F.transform("__n", lambda n: n["label"]).alias("neighbor_labels"),
            F.transform("__n", lambda n: n["similarity"]).alias("neighbor_similarities"),
        )
    )
