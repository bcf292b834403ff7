"""Model answers: asking a caller's model, parsing its words, counting its votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the words an answer may contain.
ANSWER_PATTERN = r"(?U)\b(goodware|malware)\b"

Generator = Callable[[list[str]], list[str]]


def answer_with(
    prompts: DataFrame, make_generator: Callable[[], Generator], *, prompt: str = "prompt", out: str = "raw", batch_rows: int = 8
) -> DataFrame:
    """Raw answers from a caller's model. ``make_generator`` runs once per Python worker."""

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generator = make_generator()
        for texts in batches:
            answers: list[str] = []
            for start in range(0, len(texts), batch_rows):
                asked = texts.iloc[start : start + batch_rows].tolist()
                replies = list(generator(asked))
                if len(replies) != len(asked):
                    raise RuntimeError("the model returned a different number of answers")
                answers += [str(r).strip() for r in replies]
            yield pd.Series(answers)

    return prompts.withColumn(out, generate(F.col(prompt)))


def parse_answer(raw: Column) -> Column:
    """0 or 1 if the answer names exactly one class as a whole word, else null."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(raw), F.lit(ANSWER_PATTERN), F.lit(1)))
    word = F.when(F.size(found) == 1, F.element_at(found, 1))
    return F.when(word == "goodware", 0).when(word == "malware", 1)


def required_votes(minimum: int, variants: int) -> int:
    return min(max(1, minimum), variants)


def vote_consensus(
    answers: DataFrame, *, minimum: int = 2, variants: int = 3, query_id: str = "query_id", tokens: str | None = None
) -> DataFrame:
    """Per query: votes per class, the winner if it is unique and has enough votes, unanimity.

    ``answers`` is (query_id, variant_no, variant, raw). One row per variant, so groups are tiny.
    With ``tokens`` the map of that column by variant is returned as well.
    """
    need = required_votes(minimum, variants)
    vote = parse_answer(F.col("raw"))
    extra = []
    if tokens is not None:
        extra.append(F.map_from_entries(F.collect_list(F.struct("variant", tokens))).alias(tokens))
    grouped = answers.withColumn("vote", vote).groupBy(query_id).agg(
        F.count("vote").cast("int").alias("valid_votes"),
        F.count_if(F.col("vote") == 0).cast("int").alias("goodware_votes"),
        F.count_if(F.col("vote") == 1).cast("int").alias("malware_votes"),
        F.array_sort(F.collect_list(F.struct("variant_no", "variant", "raw", "vote"))).alias("answers"),
        *extra,
    )
    top = F.greatest("goodware_votes", "malware_votes")
    winner = F.when(F.col("goodware_votes") > F.col("malware_votes"), 0).when(
        F.col("malware_votes") > F.col("goodware_votes"), 1
    )
    return (
        grouped.withColumn("consensus_votes", top)
        .withColumn("candidate", F.when(top >= need, winner))
        .withColumn("unanimous", (F.col("valid_votes") == variants) & (top == variants))
    )
