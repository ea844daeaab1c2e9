"""Offsets of messages that a stream writes batch by batch: a range per topic and batch, kept in a ledger.

The ledger lies beside the batches, in a folder that readers of the table pass over. The range of a batch
is entered before its messages are written, so a batch that is repeated finds its range and
takes it again. Every entry holds where each topic goes on, so only the newest is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionflow.session import checkpointed, removed
from mentionflow.sinks.files import batch_path, written_batches

ENTRIES_KEPT = 8
_ENTRY = "topic string, first long, next long"


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}/_offsets"


def _entry(spark: SparkSession, path: str, batch_id: int) -> dict[str, tuple[int, int]]:
    """{topic: (first offset of the batch, first one behind it)}; a row per topic."""
    rows = spark.read.schema(_ENTRY).parquet(batch_path(_folder(path), batch_id)).collect()
    return {r["topic"]: (r["first"], r["next"]) for r in rows}


def _numbered(messages: DataFrame) -> tuple[DataFrame, list]:
    """Messages with their number ``_n`` within a task, sorted by topic, and rows (task, topic, first
    number, messages)."""
    rows = messages.withColumn("_task", F.spark_partition_id()).sortWithinPartitions("topic")
    rows = checkpointed(rows.withColumn("_n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = rows.groupBy("_task", "topic").agg(F.min("_n").alias("first"), F.count(F.lit(1)).alias("n"))
    return rows, counts.orderBy("_task", "topic").collect()


def with_offsets(messages: DataFrame, path: str, batch_id: int) -> DataFrame:
    """The messages of a batch with an ``offset``: per topic without gaps, in the order of its batches. Topics are few."""
    spark = messages.sparkSession
    rows, counts = _numbered(messages)
    if not counts:
        return rows.select(*messages.columns, F.lit(None).cast("long").alias("offset"))
    entries = [n for n in written_batches(spark, _folder(path)) if n <= batch_id]
    newest = _entry(spark, path, max(entries)) if entries else {}
    repeated = bool(entries) and max(entries) == batch_id
    first = {topic: entry[0 if repeated else 1] for topic, entry in newest.items()}
    after, shifts = dict(first), []
    for row in counts:
        start = after.get(row["topic"], 0)
        shifts.append((row["_task"], row["topic"], start - row["first"]))
        after[row["topic"]] = start + row["n"]
    if not repeated:
        entry = [(topic, first.get(topic, 0), behind) for topic, behind in after.items()]
        spark.createDataFrame(entry, _ENTRY).coalesce(1).write.mode("overwrite").parquet(batch_path(_folder(path), batch_id))
        for n in sorted(entries)[:-ENTRIES_KEPT]:
            removed(spark, batch_path(_folder(path), n))
    shift = F.broadcast(spark.createDataFrame(shifts, "_task int, topic string, _shift long"))  # a row per task and topic
    placed = rows.join(shift, ["_task", "topic"])
    return placed.select(*messages.columns, (F.col("_n") + F.col("_shift")).alias("offset"))
