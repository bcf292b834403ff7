"""Index of labelled texts: embed, store, search, fetch what was found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.embed import Encoder, embed_hashing, embed_with
from vicinal.operators.knn import neighbor_metadata
from vicinal.operators.search import nearest
from vicinal.session import stored


def build_text_index(
    texts: DataFrame, *, dim: int = 64, make_encoder: Callable[[], Encoder] | None = None
) -> DataFrame:
    """``texts`` is (sample_id, text, label); adds ``vec``. The id is the caller's original index.

    The result is computed once and kept by columns, so that sizing and search read the vectors alone.
    """
    if make_encoder is not None:
        return stored(embed_with(texts, "text", make_encoder), "texts")
    return stored(embed_hashing(texts, "text", texts.columns, dim), "texts")


def search_text_index(queries: DataFrame, index: DataFrame, k: int = 5, metric: str = "l2") -> DataFrame:
    """Neighbours with the stored text and label. ``queries`` is (query_id, vec)."""
    found = nearest(queries, index, k, metric, carry=())
    return neighbor_metadata(found, index.select("sample_id", "text", F.col("label")))
