"""Vectors of rows of texts, each different text encoded once.

Sentences about numbers repeat: the same value of the same feature makes the same chunk in many rows. Texts are reduced to
different ones by a 128-bit hash before any model sees them, encoded in batches of similar length, joined back by hash and
pooled per row. A text that very many rows hold would put all of them into one task of that join; such texts, of which
there can only be few, are sent to the rows instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.functions import text as X
from vicinal.operators.embed import Encoder, called
from vicinal.session import parallelism, stored

HOT_SHARE = 1000
"""A text with more than this share (one in so many) of all references is hot, so fewer than so many texts are."""
HASH = ("h1", "h2")


@dataclass(frozen=True)
class Encoded:
    """``vectors``: (h1, h2, n, vec), one row per different text; ``n`` counts its references."""

    vectors: DataFrame
    references: int
    texts: int


def text_hash(text: Column) -> list[Column]:
    """128 bits in two numbers; different texts agree with a chance of about 2^-128."""
    return [F.xxhash64(text).alias(HASH[0]), F.xxhash64(F.lit(1), text, F.length(text)).alias(HASH[1])]


def encode_distinct(texts: DataFrame, make_encoder: Callable[[], Encoder], text: str = "text", batch_rows: int = 128) -> Encoded:
    """Encodes every different value of ``text`` once. Blank and null texts are refused, as by ``embed_with``."""
    if batch_rows <= 0:
        raise ValueError("batch_rows must be greater than zero")
    value = F.col(text)
    different = texts.select(value.alias("text"), *text_hash(value)).groupBy(*HASH).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    # nothing but the hash decides where a text goes; inside a task, texts of one length stand together
    dealt = different.repartition(4 * parallelism(texts.sparkSession), *HASH).sortWithinPartitions(F.length("text"), *HASH)
    schema = T.StructType([*(different.schema[c] for c in (*HASH, "n")), T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            vectors = called(encoder, batch.column("text").to_pylist(), batch_rows).astype(np.float64)
            column = pa.array(list(vectors), pa.list_(pa.float64()))
            yield batch.drop_columns(["text"]).append_column("vec", column)

    vectors = stored(dealt.select(*HASH, "n", "text").mapInArrow(encode, schema), "encoded")
    references, count = vectors.agg(F.sum("n"), F.count(F.lit(1))).first()
    return Encoded(vectors, references or 0, count)


def attach_vectors(references: DataFrame, encoded: Encoded) -> DataFrame:
    """``references`` (h1, h2, ...) with ``vec``. Hot texts by broadcast, fewer than ``HOT_SHARE`` of them; the others by hash."""
    least = max(1, encoded.references // HOT_SHARE)
    vectors, cold = encoded.vectors.select(*HASH, "vec"), F.col("n") <= least
    hot = encoded.vectors.where(~cold).select(*HASH, F.lit(True).alias("__hot"), F.col("vec").alias("__vec"))
    marked = references.join(F.broadcast(hot), list(HASH), "left")
    done = marked.where("__hot").withColumnRenamed("__vec", "vec").drop("__hot")
    rest = marked.where("__hot IS NULL").drop("__hot", "__vec").join(vectors, list(HASH))
    return done.unionByName(rest)


def embed_distinct(
    df: DataFrame, texts: str, make_encoder: Callable[[], Encoder], id_col: str = "sample_id", batch_rows: int = 128, out: str = "vec"
) -> tuple[DataFrame, Encoded]:
    """(``df`` without ``texts`` but with ``out``, what was encoded): the mean of a row's unit vectors, rescaled to length one.

    ``texts`` is an array of strings and ``id_col`` tells rows apart. The same rows as pooling each row by itself, where every text is
    encoded as often as it occurs. A row without texts is refused, as is a mean without direction.
    """
    rows = stored(df.withColumn("__row", F.monotonically_increasing_id()), "texts")
    spread = rows.select("__row", F.posexplode_outer(texts).alias("slot", "text"))
    encoded = encode_distinct(spread, make_encoder, "text", batch_rows)
    references = spread.select("__row", "slot", *text_hash(F.col("text")))
    found = attach_vectors(references, encoded).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("slot", "vec"))).alias("parts"))
    kept = found.join(rows.drop(texts, out), "__row").drop("__row")
    slim = kept.drop("parts")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")
            flat = lists.flatten().field("vec").flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            means = np.add.reduceat(flat.reshape(int(sizes.sum()), -1), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None] if len(sizes) else flat
            length = np.linalg.norm(means, axis=1) if len(sizes) else flat
            if not (np.isfinite(length) & (length > 0)).all():
                raise ValueError("mean embedding has no direction")
            column = pa.array(list(means / length[:, None]) if len(sizes) else [], pa.list_(pa.float64()))
            yield batch.drop_columns(["parts"]).append_column(out, column)

    pooled = kept.select("parts", *slim.columns).mapInArrow(pool, T.StructType([*slim.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))
    return pooled, encoded


def embed_rows_distinct(
    df: DataFrame,
    names: Sequence[str],
    make_encoder: Callable[[], Encoder],
    *,
    top_features: int = 128,
    per_chunk: int = 8,
    features: str = "features",
    keep: Sequence[str | Column] = ("sample_id",),
    batch_rows: int = 128,
) -> DataFrame:
    """As ``embed_rows`` with a caller's model, for models that are dearer than a shuffle."""
    chunks = X.text_chunks(X.feature_statements(X.top_abs(F.col(features), top_features), F.lit(list(names))), per_chunk)
    return embed_distinct(df.select(*keep, chunks.alias("__chunks")), "__chunks", make_encoder, batch_rows=batch_rows)[0]
