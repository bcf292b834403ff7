"""From raw documents to token ids: language, exact copies, near copies, benchmark passages, byte-level BPE.

Every stage takes what the one before it kept, as Parquet. Its decisions are attached to the rows by id and text, so rows that
share an id are told apart. Rows that repeat an id together with its text are reduced to one by the exact stage.
Null texts are empty texts, which the language stage rejects; empty tables go through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.bytepairs import decode, encode, read_ranks
from vicinal.llm.contamination import decontaminate
from vicinal.llm.exact import exact_dedup
from vicinal.llm.langid import fit, identify
from vicinal.llm.neardup import near_dedup
from vicinal.llm.rows import KEY, attach, single_rows
from vicinal.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    found = identify(docs, fit(docs), declared=F.col("lang"), host=F.col("source"))
    decided = found.groupBy("id", KEY).agg(F.max("accepted").alias("__accepted"))
    return attach(docs, decided, "doc_id", "text").where("__accepted").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    kept = exact_dedup(docs).where("kept")
    return single_rows(kept, "doc_id", "repeats").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup(docs).select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the SHA-256 of the bytes they decode to."""
    ranks = read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [("language", language), ("exact", exact), ("near", near), ("clean", clean), ("tokens", tokens)]

#: Language identification and signatures cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
