"""Sliding event-time counts. The same functions serve batch and streaming frames."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionflow.functions.times import from_micros, micros
from mentionflow.session import checkpointed

# Window length, slide, and size of a top list.
WINDOW = "5 minutes"
SLIDE = "1 minute"
TOP_K = 10

# Slots that are made from one row.
SLOTS = 4_096


def _flat(df: DataFrame, key: str, timed: bool) -> DataFrame:
    time = [F.window_time("w").alias("window_time")] if timed else []
    return df.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "count", *time
    )


def direct_count(
    rows: DataFrame, window: str = WINDOW, slide: str = SLIDE, key: str = "mention", timed: bool = False
) -> DataFrame:
    """Count per window and key, each row copied into all its windows before counting."""
    grouped = rows.groupBy(F.window("created_at", window, slide).alias("w"), key)
    return _flat(grouped.agg(F.count(F.lit(1)).alias("count")), key, timed)


def sliding_count(
    rows: DataFrame, window: str = WINDOW, slide: str = SLIDE, key: str = "mention", timed: bool = False
) -> DataFrame:
    """Count per window and key by panes: rows are counted once, in the pane they fall in,
    and only the pane counts are copied into the windows that contain the pane.

    On a stream this is two chained aggregations, so it runs in append mode. ``timed`` keeps the
    ``window_time`` of a window, by which a further step on the stream tells the time.
    """
    pane = gcd(micros(window), micros(slide))
    if pane == micros(window):
        return direct_count(rows, window, slide, key, timed)
    panes = rows.groupBy(F.window("created_at", from_micros(pane)).alias("pane"), key).agg(
        F.count(F.lit(1)).alias("n")
    )
    grouped = panes.groupBy(F.window(F.window_time("pane"), window, slide).alias("w"), key)
    return _flat(grouped.agg(F.sum("n").alias("count")), key, timed)


def zero_filled(counts: DataFrame, slide: str = SLIDE, key: str = "mention") -> DataFrame:
    """Counts with a 0 row for every later window of a key once it has been seen.

    The slots of a key lie a slide apart, from its own first window to the last window of the
    data, whatever the slide is; no calendar or zone is involved, and a count between the slots
    is kept. Slots are numbered in chunks that are dealt to tasks, so neither an array nor a task
    spans the whole period. Batch only; the counts are stored first, as they are read three times.
    """
    counts = checkpointed(counts)
    step = micros(slide)
    start, end = F.unix_micros("window_start"), F.unix_micros("window_end")
    seen = counts.groupBy(key).agg(F.min(start).alias("first"), F.max(end - start).alias("length"))
    last = counts.select(F.max(start).alias("m")).scalar()
    slots = seen.withColumn("n", F.floor((last - F.col("first")) / step)).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / SLOTS)))
    )
    slots = slots.repartition(key, "chunk").withColumn(
        "slot", F.explode(F.sequence(F.col("chunk") * SLOTS, F.least(F.col("n"), F.col("chunk") * SLOTS + SLOTS - 1)))
    )
    begin = F.col("first") + F.col("slot") * step
    slots = slots.select(key, begin.alias("_start"), (begin + F.col("length")).alias("_end"))
    known = counts.select(F.col(key).alias("_key"), start.alias("_known"), end.alias("_known_end"), "count")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_start") == F.col("_known"))
    filled = slots.join(known, same, "full")
    return filled.select(
        F.timestamp_micros(F.coalesce("_known", "_start")).alias("window_start"),
        F.timestamp_micros(F.coalesce("_known_end", "_end")).alias("window_end"),
        F.coalesce("_key", key).alias(key), F.coalesce("count", F.lit(0)).alias("count"),
    )


def top_k(
    counts: DataFrame, k: int = TOP_K, key: str = "mention", per: tuple[str, ...] = ("window_start", "window_end")
) -> DataFrame:
    """The k largest positive counts of each window, ties by key; adds ``rank``."""
    order = Window.partitionBy(*per).orderBy(F.desc("count"), F.asc(key))
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= k) & (F.col("count") > 0))


def top_k_overall(counts: DataFrame, k: int = TOP_K, key: str = "mention") -> DataFrame:
    """The k largest positive counts of all, ties by key and then by window."""
    rest = [c for c in counts.columns if c not in ("count", key)]
    return counts.where(F.col("count") > 0).orderBy(F.desc("count"), F.asc(key), *rest).limit(k)


def descending(counts: DataFrame, key: str = "mention") -> DataFrame:
    """All counts, largest first, ties by key."""
    return counts.orderBy(F.desc("count"), F.asc(key))
