"""Session settings and the shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Batch shuffles start with about one partition per this many bytes that they move, within bounds.
BYTES_PER_PARTITION = 256 * 1024 * 1024
MIN_PARTITIONS, MAX_PARTITIONS = 200, 50_000
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def initial_partitions(shuffled_bytes: int) -> int:
    return max(MIN_PARTITIONS, min(MAX_PARTITIONS, -(-shuffled_bytes // BYTES_PER_PARTITION)))


@contextmanager
def shuffling(spark: SparkSession, shuffled_bytes: int) -> Iterator[None]:
    """Queries that run within start their shuffles with partitions for this many bytes. Counts of
    any input move little, and texts move as they are: what counts is the shuffle, not the input."""
    before = spark.conf.get(INITIAL_PARTITIONS, None)
    spark.conf.set(INITIAL_PARTITIONS, str(initial_partitions(shuffled_bytes)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(INITIAL_PARTITIONS)
        else:
            spark.conf.set(INITIAL_PARTITIONS, before)


GROUPS_AT_ONCE = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


@contextmanager
def collecting(spark: SparkSession, groups: int = 8) -> Iterator[None]:
    """Arrays that are collected within, of megabytes each, are built by sorting once a task has so many of
    them, and not held by the hundred."""
    before = spark.conf.get(GROUPS_AT_ONCE)
    spark.conf.set(GROUPS_AT_ONCE, str(groups))
    try:
        yield
    finally:
        spark.conf.set(GROUPS_AT_ONCE, before)


def build_session(
    app_name: str = "mentionflow", shuffled_bytes: int = 0, conf: Mapping[str, str] | None = None
) -> SparkSession:
    """A session with the settings the jobs expect; ``conf`` overrides or adds to them.

    Batch shuffles start with enough partitions for ``shuffled_bytes`` and adaptive execution
    coalesces small ones; ``shuffling`` sets them for a job. Streams do not adapt: they use ``spark.sql.shuffle.partitions``, which
    is fixed for the life of a checkpoint and left to the caller.
    """
    settings = {
        INITIAL_PARTITIONS: str(initial_partitions(shuffled_bytes)),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf or {})
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Windows are aligned to UTC, so timestamps have to be read and shown as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="mentionflow-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/mentionflow/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so later plans start from stored rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for rows that are read more than once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job has made, in whatever file system it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
