"""Stored index tables, score caches and the fingerprints that tell whether they still apply."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.config import RunConfig

INDEX_COLUMNS = ("sample_id", "vec", "raw", "label")
FIRST_BATCH = "first"

# Settings that decide the scores, and those that decide what an index holds.
SCORING = ("target_column", "seed", "train_limit", "balance_train", "cache_version")
SHAPING = SCORING + (
    "top_k_features", "feature_order", "mode", "standardize",
    "embedding_model", "embedding_dim", "top_features_per_row", "features_per_chunk",
)


# --- fingerprints ---------------------------------------------------------------------------------


def file_parts(spark: SparkSession, path: str) -> list[str]:
    """path:size:mtime of every file below a path. Lists the files, reads none of them."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = F.concat_ws(":", "path", "length", F.unix_millis("modificationTime"))
    parts = listing.select(part.alias("p"))
    # one short line per file; folded into one hash so that a very long listing stays small
    digest = parts.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("p")).alias("x"), F.sum(F.pmod(F.xxhash64("p"), F.lit(2**31))).alias("s")).first()
    return [str(digest["n"]), str(digest["x"]), str(digest["s"])]


def payload(
    files: Sequence[str], config: RunConfig, names: Sequence[str], *, scores_only: bool = False, classes: dict | None = None, encoder: str = ""
) -> str:
    """Canonical JSON of everything that decides what is stored: inputs, names, settings, class sizes, the caller's encoder."""
    settings = config.as_dict()
    fields = SCORING if scores_only else SHAPING
    content = {
        "classes": None if classes is None else {str(k): v for k, v in classes.items()},
        "encoder": encoder,
        "files": list(files),
        "names": list(names),
        "purpose": "scores" if scores_only else "index",
        "settings": {name: settings[name] for name in fields},
    }
    return json.dumps(content, sort_keys=True)


def fingerprint(files: Sequence[str], config: RunConfig, names: Sequence[str], **more) -> str:
    return hashlib.sha256(payload(files, config, names, **more).encode("utf-8")).hexdigest()


# --- index tables ---------------------------------------------------------------------------------


def finished(spark: SparkSession, path: str) -> bool:
    """A table whose writer has left its success marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _batch_path(path: str, build: str, batch: str) -> str:
    return f"{path}/rows/{build}/{batch}"


def named_batch(batch: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9.-]+", batch) or batch == FIRST_BATCH:
        raise ValueError(f"{batch!r} is no name for a batch")


def index_exists(spark: SparkSession, path: str) -> bool:
    """Both the metadata and all batches of rows that it names must be complete."""
    if not finished(spark, f"{path}/meta"):
        return False
    meta = index_meta(spark, path)
    return all(finished(spark, _batch_path(path, meta["build"], b)) for b in meta["batches"])


def write_meta(spark: SparkSession, path: str, **values) -> None:
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    row.write.mode("overwrite").parquet(f"{path}/meta")


def save_index(rows: DataFrame, path: str, *, names: Sequence[str], config: RunConfig, signature: str) -> None:
    """Write (sample_id, vec, raw, label) and one row of metadata.

    Each fingerprint has its own folder of rows and the metadata is written last, so a build that breaks
    off never leaves new rows under an old fingerprint.
    """
    rows.select(*INDEX_COLUMNS).write.mode("overwrite").parquet(_batch_path(path, signature, FIRST_BATCH))
    write_meta(
        rows.sparkSession,
        path,
        signature=signature,
        build=signature,
        batches=[FIRST_BATCH],
        retrieval_mode=config.mode,
        model_name=config.embedding_model,
        top_features_per_row=config.top_features_per_row,
        features_per_chunk=config.features_per_chunk,
        feature_names=list(names),
    )


def append_index(rows: DataFrame, path: str, batch: str) -> str:
    """Add a named batch of rows to a stored index and return its new fingerprint.

    A batch that is sent again replaces itself, so a retry repeats no row. The fingerprint goes on with the names of the
    batches: whoever asks for the index without them does not get it.
    """
    named_batch(batch)
    spark = rows.sparkSession
    meta = index_meta(spark, path)
    rows.select(*INDEX_COLUMNS).write.mode("overwrite").parquet(_batch_path(path, meta["build"], batch))
    batches = sorted({*meta["batches"]} - {FIRST_BATCH} | {batch})
    signature = hashlib.sha256("\n".join([meta["build"], *batches]).encode("utf-8")).hexdigest()
    write_meta(spark, path, **meta | {"batches": [FIRST_BATCH, *batches], "signature": signature})
    return signature


def index_meta(spark: SparkSession, path: str) -> dict:
    return spark.read.parquet(f"{path}/meta").first().asDict()


def load_index(spark: SparkSession, path: str, mode: str | None = None) -> tuple[DataFrame, dict]:
    """(rows, metadata). An index of another retrieval mode is refused."""
    meta = index_meta(spark, path)
    if mode is not None and meta["retrieval_mode"] != mode:
        raise ValueError(f"index was built for mode {meta['retrieval_mode']!r}, not {mode!r}")
    return spark.read.parquet(*[_batch_path(path, meta["build"], b) for b in meta["batches"]]), meta


def cached_index(
    spark: SparkSession,
    path: str,
    signature: str,
    build: Callable[[], DataFrame],
    *,
    names: Sequence[str],
    config: RunConfig,
    force: bool = False,
) -> tuple[DataFrame, bool]:
    """(rows, rebuilt). Builds when forced, when nothing is stored or when the fingerprint differs."""
    stale = force or not index_exists(spark, path) or index_meta(spark, path)["signature"] != signature
    if stale:
        save_index(build(), path, names=names, config=config, signature=signature)
    return load_index(spark, path, config.mode)[0], stale


# --- score cache ----------------------------------------------------------------------------------


def cached_scores(spark: SparkSession, root: str, signature: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """(feature, score) for a fingerprint, computed and stored on first use."""
    path = f"{root}/signature={signature}"
    if not finished(spark, path):
        compute().select("feature", "score").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# --- text and vector datasets ---------------------------------------------------------------------


def save_dataset(df: DataFrame, path: str) -> None:
    """(sample_id, text or vec, label) rows."""
    df.write.mode("overwrite").parquet(path)


def load_dataset(spark: SparkSession, path: str, content: str, label: str = "label") -> DataFrame:
    """Every row must have both its content and its label."""
    df = spark.read.parquet(path)
    if not df.filter(F.col(content).isNull() | F.col(label).isNull()).isEmpty():
        raise ValueError(f"{content} and {label} have different lengths")
    return df
