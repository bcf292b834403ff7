"""One entry to the kNN join, choosing the form by the size of both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from vicinal.operators.knn import BLOCK_BYTES, FEW_BYTES, check_search, grid_shape, knn_few, knn_join, side_size
from vicinal.operators.pruned import knn_join_pruned
from vicinal.session import parallelism

PRUNE_FROM_BLOCKS = 16


def nearest(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    metric: str = "cosine",
    *,
    carry: Sequence[str] = ("label",),
    prune: bool | None = None,
) -> DataFrame:
    """Exact neighbours of (query_id, vec) in (sample_id, vec, carried columns).

    Few queries travel to the index. For more, a large index is pruned and a small one is compared as a whole; both sides
    are then read several times, so they should be stored tables or materialised. All forms give the same rows.
    """
    check_search(k, metric)
    n_query, dim = side_size(queries, "vec")
    if prune is None and n_query * dim * 4 <= FEW_BYTES:
        return knn_few(queries, index, k, metric, carry=carry)
    n_index, dim = side_size(index, "vec")
    if prune is None:
        prune = n_index * dim * 4 > PRUNE_FROM_BLOCKS * BLOCK_BYTES
    if prune:
        return knn_join_pruned(queries, index, k, metric, carry=carry)
    grid = grid_shape(n_query, n_index, dim, parallelism(queries.sparkSession))
    return knn_join(queries, index, k, metric, carry=carry, grid=grid)
