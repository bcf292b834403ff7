"""Answers of a model on reliable storage: asked once, kept for good, resumed where a run broke off.

An answer is stored under a hash of all that decides it: the prompt, the model's name and the token limit. A run looks up what
is there and asks for the rest, each different prompt once. The first wave is a job of its own, so a model that does not work is
found out at its cost. All others are one job, whose tasks leave their answers in place as each of them ends: tasks are so small
that those at work at one time hold one wave together, and whatever stops a run costs at most that. A lost executor costs its own tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.operators.answers import Generator, answer_with
from vicinal.session import parallelism, stored

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "model", "raw")])
PROMPTS_PER_TASK = 64
TASKS_PER_CORE = 4
TASK_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
"""the writer puts a task's files in place when the task ends, and a job that breaks off leaves them there"""


def answer_key(prompt: Column, model: str, max_new_tokens: int) -> Column:
    """SHA-256 of the model's name, the token limit and the prompt; lengths in front keep the parts apart."""
    head = f"{len(model)}:{model}:{max_new_tokens}:"
    return F.sha2(F.concat(F.lit(head), prompt).cast("binary"), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, raw), one row per key. A wave that was written twice by two runs at a time counts once."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA).select("key", "raw")
    return spark.read.schema(SCHEMA).parquet(path).groupBy("key").agg(F.min("raw").alias("raw"))


def answer_stored(
    prompts: DataFrame,
    make_generator: Callable[[], Generator],
    path: str,
    *,
    model: str,
    max_new_tokens: int,
    prompt: str = "prompt",
    out: str = "raw",
    batch_rows: int = 8,
    wave_prompts: int | None = None,
) -> tuple[DataFrame, int]:
    """(``prompts`` with ``out``, number of prompts that were asked now).

    ``model`` names the caller's model and everything else that shapes its answers. ``wave_prompts`` bounds what a broken
    run can lose; by default a wave keeps every core busy with a few tasks of ``PROMPTS_PER_TASK`` prompts. A null prompt
    has a null answer and is not asked. Prompts that are asked by very many rows are one row of the store; adaptive execution
    splits the rows that share one.
    """
    if not model:
        raise ValueError("the model needs a name")
    if wave_prompts is not None and wave_prompts <= 0:
        raise ValueError("wave_prompts must be greater than zero")
    spark = prompts.sparkSession
    keyed = prompts.withColumn("__key", answer_key(F.col(prompt), model, max_new_tokens))
    different = keyed.where(F.col(prompt).isNotNull()).groupBy(F.col("__key").alias("key")).agg(F.first(prompt).alias("prompt"))
    open_ = stored(different.join(read_answers(spark, path).select("key"), "key", "left_anti"), "questions")
    asked = open_.count()
    tasks = TASKS_PER_CORE * parallelism(spark)
    waves = math.ceil(asked / (wave_prompts or tasks * PROMPTS_PER_TASK))
    parts = [(open_, tasks)]
    if waves > 1:
        at, held = F.pmod(F.xxhash64("key"), F.lit(waves)), PROMPTS_PER_TASK
        if wave_prompts is not None:
            held = max(1, wave_prompts // parallelism(spark))
        parts = [(open_.where(at == 0), tasks), (open_.where(at != 0), math.ceil(asked / held))]
    for part, pieces in parts if asked else []:
        answered = answer_with(part.repartition(pieces, "key"), make_generator, batch_rows=batch_rows)
        rows = answered.select("key", F.lit(model).alias("model"), F.coalesce("raw", F.lit("")).alias("raw"))
        rows.write.mode("append").options(**TASK_BY_TASK).parquet(path)
    known = read_answers(spark, path).select(F.col("key").alias("__key"), F.col("raw").alias(out))
    return keyed.drop(out).join(known, "__key", "left").drop("__key"), asked

