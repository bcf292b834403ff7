"""Text to vectors: rows as text chunks, a built-in hashing embedder, caller models, mean pooling."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.functions import text as X
from vicinal.functions import vectors as V

BLANKS = re.compile("[ \\t\\r\\n]+")
#: Words whose place a task remembers.
WORDS_HELD = 500_000
Encoder = Callable[[list[str]], np.ndarray]


def row_chunks(
    df: DataFrame,
    names: Sequence[str],
    *,
    top_features: int = 128,
    per_chunk: int = 8,
    id_col: str = "sample_id",
    features: str = "features",
) -> DataFrame:
    """(id, chunk_no, chunk): the strongest features of a row as sentences."""
    selected = X.top_abs(F.col(features), top_features)
    statements = X.feature_statements(selected, F.lit(list(names)))
    chunks = X.text_chunks(statements, per_chunk)
    return df.select(id_col, F.posexplode_outer(chunks).alias("chunk_no", "chunk"))


def _hashing_encoder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of words between blanks, tabs and line ends; one row per text, not scaled."""
    known: dict[str, tuple[int, float]] = {}

    def place(word: str) -> tuple[int, float]:
        found = known.get(word)
        if found is None:
            if len(known) >= WORDS_HELD:
                known.clear()
            h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
            found = known[word] = h % dim, 1.0 - 2.0 * (h // dim % 2)
        return found

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for word in BLANKS.split(text):
                if word:
                    at, sign = place(word)
                    row[at] += sign
        return out

    return encode


def _units(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def embed_hashing(df: DataFrame, text: str, keys: Sequence[str], dim: int = 64, out: str = "vec") -> DataFrame:
    """(keys, vector): signed feature hashing of whitespace-separated words, as unit vectors. Runs without a model.

    Texts are embedded where they lie; nothing is shuffled. A text without words, or a null, gives the zero vector.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _hashing_encoder(dim)
        for texts in batches:
            yield pd.Series(list(_units(encode(texts.fillna("").tolist()))))

    return df.select(*keys, hashed(F.col(text)).alias(out))


def called(encoder: Encoder, texts: list[str], batch_rows: int) -> np.ndarray:
    """Unit vectors from a caller's model, ``batch_rows`` texts at a time; malformed answers raise."""
    parts = []
    for start in range(0, len(texts), batch_rows):
        values = texts[start : start + batch_rows]
        if any(t is None or not t.strip() for t in values):
            raise ValueError("blank text")
        vectors = np.asarray(encoder(values), dtype=np.float64)
        if vectors.ndim != 2 or len(vectors) != len(values):
            raise RuntimeError("the model returned a matrix of the wrong shape")
        if not np.isfinite(vectors).all():
            raise RuntimeError("the model returned NaN or infinite values")
        parts.append(_units(vectors).astype(np.float32))
    return np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)


def embed_with(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Encoder],
    out: str = "vec",
    batch_rows: int = 128,
) -> DataFrame:
    """Vectors from a caller's model.

    ``make_encoder`` runs once per Python worker and returns a function from texts to a matrix. The
    texts of an Arrow batch go to it ``batch_rows`` at a time; blank texts and malformed answers raise.
    """
    if batch_rows <= 0:
        raise ValueError("batch_rows must be greater than zero")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            yield pd.Series(list(called(encoder, texts.tolist(), batch_rows)))

    return df.withColumn(out, encode(F.col(text)))


def _checked_unit(v: Column) -> Column:
    return V.let(
        V.norm(v),
        lambda n: F.when((n > 0) & (n < float("inf")), V.l2_normalize(v)).otherwise(
            F.raise_error(F.lit("mean embedding has no direction"))
        ),
    )


def mean_pool(df: DataFrame, key: str, vec: str = "vec", out: str = "vec") -> DataFrame:
    """Mean of all vectors of a key, rescaled to length one. Adds up before the shuffle."""
    means = (
        df.select(key, F.posexplode_outer(F.col(vec)).alias("bucket", "x"))
        .groupBy(key, "bucket")
        .agg(F.avg("x").alias("s"))
        .groupBy(key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "s"))), lambda e: e["s"]).alias("__m"))
    )
    return means.select(key, _checked_unit(F.col("__m")).alias(out))


def pooled(df: DataFrame, texts: str, dim: int, make_encoder: Callable[[], Encoder] | None = None, batch_rows: int = 128, out: str = "vec") -> DataFrame:
    """Adds the mean of the unit vectors of an array of texts, rescaled to length one, and drops the texts."""
    kept = df.drop(texts)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _hashing_encoder(dim) if make_encoder is None else make_encoder()
        for batch in batches:
            lists = batch.column(texts).to_pylist()
            flat = [t for parts in lists for t in parts]
            vectors = _units(encoder(flat)) if make_encoder is None else called(encoder, flat, batch_rows).astype(np.float64)
            ends = np.cumsum([len(parts) for parts in lists])
            means = [part.mean(axis=0) if len(part) else np.zeros(dim) for part in np.split(vectors, ends[:-1])]
            if any(not 0 < np.linalg.norm(m) < np.inf for m in means):
                raise ValueError("mean embedding has no direction")
            column = pa.array([m / np.linalg.norm(m) for m in means], pa.list_(pa.float64()))
            yield batch.drop_columns([texts]).append_column(out, column)

    return df.mapInArrow(pool, T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def embed_rows(
    df: DataFrame,
    names: Sequence[str],
    *,
    dim: int = 64,
    top_features: int = 128,
    per_chunk: int = 8,
    make_encoder: Callable[[], Encoder] | None = None,
    id_col: str = "sample_id",
    features: str = "features",
    keep: Sequence[str | Column] = (),
    batch_rows: int = 128,
) -> DataFrame:
    """(id, vec): chunk vectors of the row, averaged and rescaled. Uses the hashing embedder unless a model is given.

    A row's chunks stay in the row: they are written, embedded and pooled without a shuffle.
    """
    selected = X.top_abs(F.col(features), top_features)
    chunks = X.text_chunks(X.feature_statements(selected, F.lit(list(names))), per_chunk)
    rows = df.select(*(keep or [id_col]), chunks.alias("__chunks"))
    return pooled(rows, "__chunks", dim, make_encoder, batch_rows)
