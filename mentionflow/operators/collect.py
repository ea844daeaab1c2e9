"""Sliding collections of records, in bounded arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionflow.functions.times import micros
from mentionflow.operators.lookup import BROADCAST_ROWS, lookup_join
from mentionflow.operators.windows import SLIDE, WINDOW
from mentionflow.session import checkpointed

MAX_RECORDS = 1_000
MAX_BYTES = 16 * 1024 * 1024


def windowed(rows: DataFrame, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """Every row once per window that contains it; no shuffle."""
    placed = rows.withColumn("_w", F.window("created_at", window, slide))
    return placed.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *rows.columns
    )


def _floor(value: Column, step: int) -> Column:
    return value - F.pmod(value, F.lit(step))


def _with_blocks(rows: DataFrame, window_ms: int, slide_ms: int, block_ms: int) -> DataFrame:
    """Every row once per block that starts one of its windows."""
    at = F.unix_millis("created_at")
    first_window = _floor(at - window_ms, slide_ms) + slide_ms
    first_block = _floor(first_window, block_ms)
    last_block = _floor(at, block_ms)
    blocks = F.sequence(first_block, last_block, F.lit(block_ms))
    return rows.withColumn("_block", F.explode(blocks))


def _below(items: Column, bound: Column) -> Column:
    """How many of the items, sorted by ``at``, lie before ``bound``: a binary search in the row."""
    n = F.size(items)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), n.alias("high"))

    def halved(range_: Column, _: Column) -> Column:
        low, high = range_["low"], range_["high"]
        middle = F.floor((low + high) / 2).cast("int")
        before = F.get(items, middle)["at"] < bound
        open_ = low < high
        return F.struct(
            F.when(open_ & before, middle + 1).otherwise(low).alias("low"),
            F.when(open_ & ~before, middle).otherwise(high).alias("high"),
        )

    return F.aggregate(steps, start, halved, lambda range_: range_["low"])


def _crowded(rows: DataFrame, size_by: Sequence[str], max_records: int, max_bytes: int) -> DataFrame:
    """(group, parts) for the groups with more rows or bytes of text than fit into one array."""
    size = F.sum(F.octet_length("text")) if "text" in rows.columns else F.lit(0)
    sizes = rows.groupBy("_block", *size_by).agg(F.count(F.lit(1)).alias("_n"), F.coalesce(size, F.lit(0)).alias("_size"))
    parts = F.greatest(F.ceil(F.col("_n") / max_records), F.ceil(F.col("_size") / max_bytes)).cast("int")
    sized = sizes.select(F.struct("_block", *size_by).alias("_group"), parts.alias("_parts"))
    return sized.where(F.col("_parts") > 1)


def sliding_collect(
    rows: DataFrame,
    record: Column,
    key: str = "mention",
    window: str = WINDOW,
    slide: str = SLIDE,
    distinct: bool = True,
    size_by: Sequence[str] | None = None,
    max_records: int = MAX_RECORDS,
    broadcast_rows: int = BROADCAST_ROWS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """The records of each window and key as arrays of about ``max_records``, and ``max_bytes``
    of text, at most.

    ``rows`` have ``id``, ``created_at``, the key and whatever ``record`` uses. The result has
    ``window_start``, ``window_end``, the key, ``part``, ``parts`` and ``records``; a group
    that fits into one array is one row, a larger one is split by post into ``parts`` rows.

    A record is shuffled once per block of windows, not once per window: a block is four
    window lengths of window starts, so a record goes to 1.2 blocks or so. Its array is sorted by
    time, once; a window is the slice between two bounds that are found by binary search.

    Sizes are counted beforehand, per block and key. For a key that is costly to compute,
    ``size_by`` names cheaper columns to count by, or none; then the parts come out smaller.
    """
    size_by = [key] if size_by is None else list(size_by)
    window_ms, slide_ms = micros(window) // 1000, micros(slide) // 1000
    per_block = 4 * max(1, window_ms // slide_ms)
    block_ms = per_block * slide_ms
    blocks = _with_blocks(rows, window_ms, slide_ms, block_ms)

    crowded = checkpointed(_crowded(blocks, size_by, max_records, max_bytes))
    if crowded.isEmpty():
        sized = blocks.withColumn("_parts", F.lit(1))
    else:
        group = F.struct("_block", *size_by)
        found = lookup_join(blocks, crowded, group, "_group", "left", F.col("id"), max_rows=broadcast_rows)
        sized = found.withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    # Equal records meet in one part, where they collapse; if they must not, spread them too.
    identity = ["id", "created_at"]
    spread = F.xxhash64(*identity) if distinct else F.xxhash64(*identity, F.monotonically_increasing_id())
    gather = F.collect_set if distinct else F.collect_list
    item = F.struct(F.unix_millis("created_at").alias("at"), record.alias("record"))
    gathered = (
        sized.withColumn("part", F.pmod(spread, F.col("_parts")).cast("int"))
        .groupBy("_block", key, "part", "_parts")
        .agg(F.sort_array(gather(item)).alias("_items"))
    )
    cuts = F.transform(
        F.sequence(F.lit(0), F.lit(per_block - 1)),
        lambda n: F.struct(
            (F.col("_block") + n * slide_ms).alias("start"),
            _below(F.col("_items"), F.col("_block") + n * slide_ms).alias("low"),
            _below(F.col("_items"), F.col("_block") + n * slide_ms + window_ms).alias("high"),
        ),
    )
    return gathered.select(
        key, "part", "_parts", "_items", F.explode(F.filter(cuts, lambda c: c["low"] < c["high"])).alias("_cut")
    ).select(
        F.timestamp_millis("_cut.start").alias("window_start"),
        F.timestamp_millis(F.col("_cut.start") + window_ms).alias("window_end"),
        key,
        "part",
        F.col("_parts").alias("parts"),
        F.sort_array(F.slice("_items.record", F.col("_cut.low") + 1, F.col("_cut.high") - F.col("_cut.low"))).alias("records"),
    )
