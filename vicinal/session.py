"""Session settings and the places where a job may cut its lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCOPE: ContextVar[str | None] = ContextVar("scratch", default=None)


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "vicinal") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read, taken from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a new temporary folder; a cluster is refused,
    because a machine-local folder would be lost with the machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="vicinal-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a table a job writes and reads back."""
    return f"{_SCOPE.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Tables that jobs write inside lie in one folder, which is deleted at the end, also after an error.

    Results that are still needed must have been written elsewhere by then: a table that is only planned reads from there.
    """
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _SCOPE.set(path)
    try:
        yield path
    finally:
        _SCOPE.reset(token)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, keep on reliable storage, and forget the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: columnar, so later reads take what they need.

    ``options`` are those of Spark's Parquet writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """Jobs that run inside send rows to their Python workers in batches of about ``most_bytes``; a longer row is a batch of its own.

    Spark's own bound is 10,000 rows or 64 MB. A batch is held by the executor, while its buffers double, and by the worker, which
    is kept for later tasks. For plans that are only returned this sets nothing.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out to all cores.

    A file with one row group is read by one task, which then does all the work per row. A large scan
    has more partitions than there are cores and is left alone, so nothing is shuffled at scale.
    For plain scans only: counting the partitions of a longer plan would run part of it.
    """
    cores = parallelism(scan.sparkSession)
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
