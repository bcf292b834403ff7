"""Final decision from the neighbour vote and the model's candidate, and the result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.operators.labels import label_name

# Names of the decision branches.
FALLBACK = "mv_fallback_no_llm"
ALWAYS = "llm_always_overrides"
AGREES = "llm_agrees_with_mv"
OVERRIDES = "unanimous_llm_overrides_uncertain_mv"
RETAINED = "mv_retained"


def decide(vote: Column, margin: Column, candidate: Column, unanimous: Column, always_override: bool = False) -> Column:
    """Struct of final, pred_type, decision_source, override_applied; the first rule that holds wins."""

    def outcome(value: Column, kind: str, source: str, override: bool) -> Column:
        return F.struct(
            value.cast("int").alias("final"),
            F.lit(kind).alias("pred_type"),
            F.lit(source).alias("decision_source"),
            F.lit(override).alias("override_applied"),
        )

    rules = F.when(candidate.isNull(), outcome(vote, "MV", FALLBACK, False))
    if always_override:
        return rules.otherwise(outcome(candidate, "LLM", ALWAYS, True))
    return (
        rules.when(candidate == vote, outcome(vote, "LLM", AGREES, False))
        .when((margin <= 1) & unanimous, outcome(candidate, "LLM", OVERRIDES, True))
        .otherwise(outcome(vote, "MV", RETAINED, False))
    )


def fuse(votes: DataFrame, consensus: DataFrame, *, always_override: bool = False, query_id: str = "query_id") -> DataFrame:
    """Join both sides per query and decide. ``votes`` has prediction and margin."""
    joined = votes.join(consensus, query_id)
    decision = decide(F.col("prediction"), F.col("margin"), F.col("candidate"), F.col("unanimous"), always_override)
    return joined.withColumn("__d", decision).select("*", "__d.*").drop("__d")


def result_rows(fused: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The full result table: the id and 24 columns.

    ``fused`` also carries true_label, neighbor_labels, neighbor_similarities and prompt_tokens.
    """
    candidate = F.col("candidate")
    return fused.select(
        query_id,
        label_name(F.col("final")).alias("prediction"),
        label_name(F.col("true_label")).alias("true_label"),
        "pred_type",
        F.col("final").alias("prediction_num"),
        F.col("true_label").alias("true_label_num"),
        "decision_source",
        F.coalesce(label_name(candidate), F.lit("invalid")).alias("llm_prediction"),
        candidate.alias("llm_prediction_num"),
        F.col("valid_votes").alias("llm_valid_votes"),
        F.col("consensus_votes").alias("llm_consensus_votes"),
        F.col("goodware_votes").alias("llm_goodware_votes"),
        F.col("malware_votes").alias("llm_malware_votes"),
        F.col("unanimous").alias("llm_unanimous"),
        F.col("override_applied").alias("llm_override_applied"),
        label_name(F.col("prediction")).alias("mv_prediction"),
        F.col("prediction").alias("mv_prediction_num"),
        F.col("votes_0").cast("int").alias("mv_goodware_votes"),
        F.col("votes_1").cast("int").alias("mv_malware_votes"),
        F.col("margin").cast("int").alias("mv_margin"),
        "neighbor_labels",
        "neighbor_similarities",
        F.transform(F.filter("answers", lambda a: a["vote"].isNotNull()), lambda a: a["vote"]).alias("llm_votes"),
        F.map_from_entries(F.transform("answers", lambda a: F.struct(a["variant"], a["raw"]))).alias("llm_raw_outputs"),
        "prompt_tokens",
    )
