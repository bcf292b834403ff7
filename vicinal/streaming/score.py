"""Score rows as they arrive against a stored index."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinal.operators.search import nearest
from vicinal.operators.vote import majority_vote
from vicinal.session import stored
from vicinal.sources.store import index_exists, load_index

VERSION_WAIT = 60
"""seconds that a batch waits for a writer that is replacing the metadata"""


def _scored(rows: DataFrame, sink: str, checkpoint: str, votes: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each micro-batch is written once, sized and searched from there, and its votes replace those of a repeated batch."""

    def score(batch: DataFrame, batch_id: int) -> None:
        votes(stored(batch, "arrived")).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        rows.select("query_id", F.col("vec"))
        .writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    rows: DataFrame, index: DataFrame, k: int, sink: str, checkpoint: str, *, metric: str = "cosine"
) -> StreamingQuery:
    """Vote for every arriving (query_id, vec) and write the votes as Parquet below ``sink``.

    Each micro-batch writes its own folder and replaces it if the batch is repeated, so a restart
    leaves no duplicates. A batch travels to the index, which is not shuffled. The stream processes what is available and stops.
    """
    return _scored(rows, sink, checkpoint, lambda batch: majority_vote(nearest(batch, index, k, metric)))


def current_index(spark: SparkSession, path: str, mode: str | None = None, wait: float = VERSION_WAIT) -> tuple[DataFrame, str]:
    """(rows, fingerprint) of the index as it is now. Waits while a writer replaces the metadata."""
    end = time.monotonic() + wait
    while True:
        try:
            if index_exists(spark, path):
                rows, meta = load_index(spark, path, mode)
                return rows, meta["signature"]
        except AnalysisException:  # the metadata went away between two steps
            pass
        if time.monotonic() > end:
            raise ValueError(f"no complete index at {path}")
        time.sleep(0.5)


def score_stream_versions(
    rows: DataFrame, path: str, k: int, sink: str, checkpoint: str, *, metric: str = "cosine", mode: str | None = None
) -> StreamingQuery:
    """As ``score_stream``, against a stored index that may be appended to or built anew while the stream runs.

    Every micro-batch reads the metadata first and keeps to that version of the index throughout; its votes carry the
    fingerprint as ``index_version``. A batch that is repeated after a failure takes the version of that time.
    """

    def votes(batch: DataFrame) -> DataFrame:
        index, version = current_index(batch.sparkSession, path, mode)
        return majority_vote(nearest(batch, index, k, metric)).withColumn("index_version", F.lit(version))

    return _scored(rows, sink, checkpoint, votes)
