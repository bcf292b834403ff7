"""What the neighbours of a query say, and the examples shown in a prompt."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vicinal.functions import text as X
from vicinal.functions import vectors as V
from vicinal.operators.blocks import as_matrix
from vicinal.operators.knn import BLOCK_BYTES, MOST_PARTITIONS, block_of, side_size
from vicinal.operators.labels import label_name
from vicinal.operators.vote import vote_columns, vote_prediction
from vicinal.session import parallelism
LOOKUP_ROWS = 1 << 15
"""rows of a block, and pointers at it, that a task holds at most; smaller blocks send no row more often"""


def single_precision(similarity: Column) -> Column:
    """Similarities are reported in single precision."""
    return similarity.cast("float").cast("double")


def similarity_weight(similarity: Column) -> Column:
    return F.least(F.greatest((similarity + 1.0) / 2.0, F.lit(0.0)), F.lit(1.0))


def neighbor_evidence(neighbors: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Per query: counts, mean similarity and summed weight per class, nearest class, majority."""
    s = single_precision(F.col("similarity"))
    label = F.col("label")

    def mean(c: int) -> Column:
        return F.coalesce(F.avg(F.when(label == c, s)), F.lit(0.0))

    def weight(c: int) -> Column:
        return F.coalesce(F.sum(F.when(label == c, similarity_weight(s))), F.lit(0.0))

    return (
        neighbors.groupBy(query_id)
        .agg(
            *vote_columns(label, F.col("rank")),
            mean(0).alias("mean_similarity_0"),
            mean(1).alias("mean_similarity_1"),
            weight(0).alias("weight_0"),
            weight(1).alias("weight_1"),
        )
        .withColumn("majority", vote_prediction())
    )


def with_distance(
    neighbors: DataFrame, queries: DataFrame, index: DataFrame, *, index_id: str = "sample_id", query_id: str = "query_id"
) -> DataFrame:
    """Neighbours with the raw vector of the stored row and the mean absolute distance to the query.

    ``queries`` is (query id, raw), ``index`` is (index id, raw). A row that is a neighbour of very many
    queries makes a skewed join, which adaptive execution splits.
    """
    stored = index.select(index_id, V.as_float(F.col("raw")).alias("raw"))
    asked = queries.select(query_id, V.as_float(F.col("raw")).alias("query_raw"))
    joined = neighbors.join(stored, index_id).join(asked, query_id)
    return joined.withColumn("mean_abs_distance", V.mean_abs_distance(F.col("query_raw"), F.col("raw")))


def with_distance_in_blocks(
    neighbors: DataFrame, queries: DataFrame, index: DataFrame, *, index_id: str = "sample_id", query_id: str = "query_id", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The same rows as ``with_distance``, in a second pass over the blocks of the index that hold a neighbour.

    Neighbours, with their query's raw vector, go to the block of the row they point at, which is a hash of its id. Inside
    a block rows are looked up by id. A block with many pointers, one with a hub for example, is met by several tasks, each
    with its share of the pointers and a copy of that block, so no task grows with a hub.
    """
    spark = neighbors.sparkSession
    rows, dim = side_size(index, "raw")
    per_block = max(1, min(LOOKUP_ROWS, block_bytes // (4 * max(1, dim))))
    blocks = max(1, -(-rows // per_block))
    asked = queries.select(query_id, V.as_float(F.col("raw")).alias("query_raw"))
    pointers = neighbors.join(asked, query_id).withColumn("ib", block_of(F.col(index_id), blocks))
    plan = [(r["ib"], -(-r["count"] // per_block)) for r in neighbors.select(block_of(F.col(index_id), blocks).alias("ib")).groupBy("ib").count().collect()]
    parts = spark.createDataFrame(plan, "ib int, parts int")  # one row per block
    left = pointers.join(F.broadcast(parts), "ib").withColumn("qb", F.pmod(F.xxhash64(query_id, "rank"), F.col("parts")).cast("int")).drop("parts")
    right = index.select(F.col(index_id).alias("__id"), V.as_float(F.col("raw")).alias("raw")).withColumn("ib", block_of(F.col("__id"), blocks))
    right = right.join(F.broadcast(parts), "ib").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    added = [T.StructField("raw", T.ArrayType(T.FloatType())), T.StructField("mean_abs_distance", T.DoubleType())]
    schema = T.StructType([*[f for f in left.schema if f.name not in ("ib", "qb")], *added])
    arrow = to_arrow_schema(schema)

    def look_up(own: pa.Table, block: pa.Table) -> pa.Table:
        if not own.num_rows or not block.num_rows:
            return arrow.empty_table()
        at = pc.index_in(own[index_id], value_set=block["__id"].combine_chunks())
        own, at = own.filter(at.is_valid()), at.drop_null()
        found = block["raw"].take(at)
        if not own.num_rows:
            return arrow.empty_table()
        a, b = as_matrix(own["query_raw"], "queries"), as_matrix(found, "index")
        far = np.abs(a.astype(np.float64) - b.astype(np.float64)).sum(axis=1) / a.shape[1]
        return own.append_column("raw", found).append_column("mean_abs_distance", pa.array(far)).select(arrow.names).cast(arrow)

    tasks = max(parallelism(spark), min(2 * sum(n for _, n in plan), MOST_PARTITIONS))
    sides = [s.repartition(tasks, "ib", "qb").groupBy("ib", "qb") for s in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(look_up, schema)


def prompt_examples(
    with_raw: DataFrame,
    labels: Sequence[str],
    *,
    max_examples: int = 5,
    max_features: int = 20,
    query_id: str = "query_id",
) -> DataFrame:
    """(query_id, examples, query_items): the nearest examples as text fragments, nearest first."""
    near = with_raw.filter(F.col("rank") <= max_examples)
    head = F.concat(
        F.lit("label="),
        F.upper(label_name(F.col("label"))),
        F.lit("; cosine_similarity="),
        X.fixed(single_precision(F.col("similarity")), 4, signed=True),
        F.lit("; full_vector_mean_abs_distance="),
        X.fixed(F.col("mean_abs_distance").cast("float"), 4),
        F.lit("; displayed_features=["),
    )
    fragments = near.select(
        query_id,
        "rank",
        head.alias("head"),
        X.display_items(F.col("raw"), list(labels), max_features).alias("items"),
        F.when(F.col("rank") == 1, X.display_items(F.col("query_raw"), list(labels), max_features)).alias("query_items"),
    )
    return fragments.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", "head", "items"))).alias("examples"),
        F.max_by("query_items", -F.col("rank")).alias("query_items"),
    )
