"""Tables of keyed rows that micro-batches change: written as deltas, merged when read, compacted now and then.

A batch writes what has changed, so its bytes follow the changes and not the table. The newest row of
a key counts. Every so many batches the table is written whole as a base, and what it replaces is
removed one compaction later, when no reader that has started before goes through it any more. A
repeated batch replaces its own delta.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionflow.session import removed
from mentionflow.sinks.files import batch_path, written_batches

COMPACT_EVERY = 30


def _folders(path: str) -> tuple[str, str]:
    return f"{path.rstrip('/')}/base", f"{path.rstrip('/')}/delta"


def _merged(spark: SparkSession, path: str, keys: Sequence[str], until: int | None = None) -> DataFrame | None:
    base, delta = _folders(path)
    bases = [n for n in written_batches(spark, base) if until is None or n <= until]
    deltas = written_batches(spark, delta)
    start = max(bases, default=-1)
    parts = [batch_path(base, start)] if bases else []
    parts += [batch_path(delta, n) for n in sorted(deltas) if n > start and (until is None or n <= until)]
    if not parts:
        return None
    rows = spark.read.option("mergeSchema", "false").parquet(*parts)
    names = [c for c in rows.columns if c not in (*keys, "_batch")]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("_batch", *names)).alias("_newest"))
    return newest.select(*keys, "_newest._batch", *[f"_newest.{c}" for c in names])


def upsert(
    changed: DataFrame, path: str, batch_id: int, keys: Sequence[str], compact_every: int = COMPACT_EVERY,
    kept: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Writes the rows that a batch has changed; ``kept`` says which rows a compaction keeps."""
    spark = changed.sparkSession
    base, delta = _folders(path)
    marked = changed.withColumn("_batch", F.lit(batch_id).cast("long"))
    marked.write.mode("overwrite").parquet(batch_path(delta, batch_id))
    if (batch_id + 1) % compact_every:
        return
    whole = _merged(spark, path, keys, batch_id)
    (whole if kept is None else kept(whole)).write.mode("overwrite").parquet(batch_path(base, batch_id))
    earlier = [n for n in written_batches(spark, base) if n < batch_id]
    if earlier:
        before = max(earlier)
        for n in written_batches(spark, delta):
            if n <= before:
                removed(spark, batch_path(delta, n))
        for n in earlier:
            if n < before:
                removed(spark, batch_path(base, n))


def current(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key."""
    rows = _merged(spark, path, keys)
    if rows is None:
        raise FileNotFoundError(f"no batch has been written to {path}")
    return rows.drop("_batch")
