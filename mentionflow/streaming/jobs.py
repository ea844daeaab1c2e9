"""Streaming jobs: counts, scored mentions, sentiment messages, reports and the consumer.

Windows are on event time, and a window comes out once, when the watermark has passed its
end. State is counts only: scored posts are kept in a table, and the window counts say
which windows of the table are complete.
"""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mentionflow.functions.scoring import Scorer
from mentionflow.operators.bloom import bloom_filter
from mentionflow.operators.collect import MAX_RECORDS
from mentionflow.operators.messages import count_messages, decoded_counts, sentiment_messages, to_topic
from mentionflow.operators.posts import counted_mentions, original_posts
from mentionflow.operators.sentiment import scored_mentions, sentiment_groups
from mentionflow.operators.windows import SLIDE, TOP_K, WINDOW, direct_count, sliding_count
from mentionflow.session import ROCKSDB, checkpointed, collecting
from mentionflow.sinks import upserts
from mentionflow.sinks.files import batch_path, write_messages, write_text
from mentionflow.functions.times import micros
from mentionflow.sinks.ledger import with_offsets
from mentionflow.sinks.reports import in_report_order, sentiment_report, top_k_report

BATCH_INTERVAL = "1 minute"
REFRESH_INTERVAL = "5 seconds"
WATERMARK = "10 minutes"
MAX_RUN_SECONDS = 5 * 60 * 60
DRAIN_SECONDS = 60.0
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
COUNT_KEYS = ("window_start", "window_end", "mention")
RECOUNT_KEYS = ("window_end", "handle")

SCORED_MENTIONS = T.StructType(
    [
        T.StructField("mention", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("text", T.StringType()),
        T.StructField("cat", T.StringType()),
        T.StructField("polarity", T.DoubleType()),
        T.StructField("day", T.DateType()),
    ]
)

# What is done with the closed windows of a micro-batch: (counts, batch id).
Output = Callable[[DataFrame, int], None]


def every(interval: str = BATCH_INTERVAL) -> dict:
    return {"processingTime": interval}


AVAILABLE_NOW = {"availableNow": True}


def drain(queries: Sequence[StreamingQuery], max_seconds: float = DRAIN_SECONDS, poll_seconds: float = 0.05) -> None:
    """Stop each query when its running micro-batch has ended, or ``max_seconds`` are over. One that
    starts its next batch at once is stopped as that one begins."""
    deadline = time.monotonic() + max_seconds
    at_start = {query.id: (query.lastProgress or {}).get("batchId") for query in queries}
    waiting = list(queries)
    while waiting:
        for query in list(waiting):
            ended = (query.lastProgress or {}).get("batchId") != at_start[query.id]
            if not query.isActive or not query.status["isTriggerActive"] or ended or time.monotonic() > deadline:
                query.stop()
                waiting.remove(query)
        if waiting:
            time.sleep(poll_seconds)


def run_bounded(
    queries: Sequence[StreamingQuery], max_seconds: float = MAX_RUN_SECONDS, poll_seconds: float = 0.5,
    drain_seconds: float = DRAIN_SECONDS,
) -> None:
    """Run the queries until all have ended, one has failed, ``max_seconds`` are over or the
    process is asked to stop (SIGTERM, SIGINT), and stop them in any case.

    All queries are watched together; the failure of one is raised at once. The time limit and
    a signal are regular ends: running micro-batches may take up to ``drain_seconds`` to finish.
    Signals are only handled when called from the main thread, and earlier handlers are put back.
    """
    deadline = time.monotonic() + max_seconds
    stop = threading.Event()
    handled = {}
    try:
        if threading.current_thread() is threading.main_thread():
            for sign in (signal.SIGTERM, signal.SIGINT):
                handled[sign] = signal.signal(sign, lambda *_: stop.set())
        while True:
            active = [query.isActive for query in queries]
            for query in queries:
                if query.exception() is not None:
                    raise query.exception()
            left = deadline - time.monotonic()
            if not any(active) or left <= 0 or stop.wait(min(poll_seconds, left)):
                drain(queries, drain_seconds)
                return
    finally:
        for query in queries:
            query.stop()
        for sign, earlier in handled.items():
            signal.signal(sign, earlier)


def wait_for_rows(query: StreamingQuery, max_seconds: float = 600) -> None:
    """Wait until a query has written its first rows, so that another can read its table."""
    deadline = time.monotonic() + max_seconds
    while not any(p["numInputRows"] for p in query.recentProgress):
        if query.exception() is not None:
            raise query.exception()
        if time.monotonic() > deadline or not query.isActive:
            raise TimeoutError("the query has not written any rows")
        time.sleep(0.5)


def window_counts(
    posts: DataFrame,
    keys: DataFrame,
    window: str = WINDOW,
    slide: str = SLIDE,
    watermark: str | None = WATERMARK,
    fold_case: bool = False,
    panes: bool = True,
    timed: bool = False,
) -> DataFrame:
    """Streaming counts per window and mention of a stream of posts. ``watermark`` is None where the
    sources have their own."""
    marked = posts if watermark is None else posts.withWatermark("created_at", watermark)
    mentions = counted_mentions(original_posts(marked), keys, fold_case)
    return (sliding_count if panes else direct_count)(mentions, window, slide, timed=timed)


def start_counts(counts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write count messages of closed windows, with offsets, to a message table."""
    return start_outputs(counts, [count_output(path)], checkpoint, trigger)


def start_early_counts(
    posts: DataFrame, keys: DataFrame, path: str, checkpoint: str, window: str = WINDOW, slide: str = SLIDE,
    watermark: str | None = WATERMARK, fold_case: bool = False, compact_every: int = upserts.COMPACT_EVERY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Counts of windows as they grow: every micro-batch upserts the windows it has changed, so
    ``early_counts`` shows open windows too, and closed ones with their last count."""
    counts = window_counts(posts, keys, window, slide, watermark, fold_case, panes=False)

    def write(batch: DataFrame, batch_id: int) -> None:
        upserts.upsert(batch, path, batch_id, COUNT_KEYS, compact_every)

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or every()))
        .start()
    )


def early_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all windows so far."""
    return upserts.current(spark, path, COUNT_KEYS)


def start_table(
    rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, state_provider: str = ROCKSDB
) -> StreamingQuery:
    """Append rows to a table; for steps with timers, which need the RocksDB state store."""
    with_state = rows.sparkSession.conf
    before = with_state.get(STATE_PROVIDER, None)
    with_state.set(STATE_PROVIDER, state_provider)
    try:
        return (
            rows.writeStream.outputMode("append")
            .format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or every()))
            .start()
        )
    finally:  # a started query keeps the settings that it has found
        if before is None:
            with_state.unset(STATE_PROVIDER)
        else:
            with_state.set(STATE_PROVIDER, before)


def start_count_topic(counts: DataFrame, checkpoint: str, trigger: dict | None = None, **options: str) -> StreamingQuery:
    """The same to a broker; needs the Kafka connector on the class path."""
    writer = to_topic(count_messages(counts)).writeStream.format("kafka")
    return (
        writer.outputMode("append")
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or every()))
        .start()
    )


def start_outputs(
    counts: DataFrame, outputs: Sequence[Output], checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Several outputs of the same closed windows, computed once per micro-batch."""

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for output in outputs:
                output(batch, batch_id)
        finally:
            batch.unpersist()

    return (
        counts.writeStream.outputMode("append")
        .foreachBatch(emit)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or every()))
        .start()
    )


def count_output(path: str, fmt: str = "parquet", **options: str) -> Output:
    def write(counts: DataFrame, batch_id: int) -> None:
        built = count_messages(counts)
        if fmt != "kafka":  # a broker has its own offsets
            built = with_offsets(built, path, batch_id)
        write_messages(built, fmt, batch_path(path, batch_id), "overwrite", **options)

    return write


def top_k_output(path: str, k: int = TOP_K, window: str = WINDOW) -> Output:
    def write(counts: DataFrame, batch_id: int) -> None:
        report = top_k_report(counts, k, window).orderBy("window_start")
        write_text(report, batch_path(path, batch_id), "overwrite")

    return write


def start_scored_table(
    posts: DataFrame,
    keys: DataFrame,
    path: str,
    checkpoint: str,
    scorer: Scorer | None = None,
    strict_reference: bool = False,
    trigger: dict | None = None,
    **sink_options: str,
) -> StreamingQuery:
    """Score posts as they arrive and append them to a table split by day.

    ``retention``, e.g. ``7d``, is a useful sink option: it bounds the list of files that readers go through,
    and hides rows older than that.
    """
    scored = scored_mentions(original_posts(posts), keys, scorer, strict_reference)
    return (
        scored.withColumn("day", F.to_date("created_at"))
        .writeStream.outputMode("append")
        .partitionBy("day")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .options(**{"compression": "zstd", **sink_options})
        .trigger(**(trigger or every()))
        .start()
    )


def scored_table_counts(
    spark: SparkSession, path: str, window: str = WINDOW, slide: str = SLIDE, watermark: str = WATERMARK
) -> DataFrame:
    """Streaming counts over the scored table; a window in it is complete in the table."""
    rows = spark.readStream.schema(SCORED_MENTIONS).parquet(path)
    narrow = rows.select("created_at", "mention").withWatermark("created_at", watermark)
    return sliding_count(narrow, window, slide)


def _closed(counts: DataFrame) -> tuple | None:
    """First start, first end and last end of the windows, as timestamps made from microseconds:
    local date-times would be ambiguous when clocks change."""
    found = counts.agg(
        F.unix_micros(F.min("window_start")), F.unix_micros(F.min("window_end")), F.unix_micros(F.max("window_end"))
    ).first()
    return None if found[0] is None else tuple(F.timestamp_micros(F.lit(n)) for n in found)


def _rows_between(spark: SparkSession, table: str, start: Column, end: Column) -> DataFrame:
    rows = spark.read.schema(SCORED_MENTIONS).parquet(table)
    days = F.col("day").between(F.to_date(start), F.to_date(end))
    return rows.where(days & (F.col("created_at") >= start) & (F.col("created_at") < end)).drop("day")


def sentiment_output(
    table: str, path: str, window: str = WINDOW, slide: str = SLIDE, max_records: int = MAX_RECORDS,
    fmt: str = "parquet", **options: str,
) -> Output:
    """Sentiment messages of the closed windows, from the scored table."""

    def write(counts: DataFrame, batch_id: int) -> None:
        closed = _closed(counts)
        if closed is None:
            return
        start, first, last = closed
        rows = _rows_between(counts.sparkSession, table, start, last)
        groups = sentiment_groups(rows, window, slide, max_records)
        done = groups.where(F.col("window_end").between(first, last))
        target = batch_path(path, batch_id)
        with collecting(counts.sparkSession):
            write_messages(sentiment_messages(done), fmt, target, "overwrite", **options)

    return write


def _once(rows: DataFrame) -> DataFrame:
    """The posts of scored mentions, each once. Posts with a single row stay where they are; what comes several
    times, and what a Bloom filter takes for it, is shuffled with its text."""
    post = F.xxhash64("id", "created_at")
    several = rows.groupBy("id", "created_at").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(post.alias("of"))
    several = checkpointed(several)
    posts = rows.drop("mention")
    if several.isEmpty():
        return posts
    maybe = bloom_filter(several, "of")(post)
    return posts.where(~maybe).unionByName(checkpointed(posts.where(maybe).dropDuplicates(["id", "created_at"])))


def sentiment_report_output(table: str, path: str, window: str = WINDOW, slide: str = SLIDE, **options: str) -> Output:
    """The sentiment report of the closed windows, from the scored table. A post with several
    mentions is one line. ``options`` are those of the text writer, e.g. ``compression``."""

    def write(counts: DataFrame, batch_id: int) -> None:
        closed = _closed(counts)
        if closed is None:
            return
        start, first, last = closed
        rows = _rows_between(counts.sparkSession, table, start, last)
        lines = in_report_order(sentiment_report(_once(rows), window, slide, (first, last), keep=False))
        write_text(lines, batch_path(path, batch_id), "overwrite", **options)

    return write


def start_recount(
    messages: DataFrame, path: str, checkpoint: str, watermark: str = WATERMARK, keep: str | None = None,
    compact_every: int = upserts.COMPACT_EVERY, trigger: dict | None = None,
) -> StreamingQuery:
    """Counts per handle and window from count messages, refreshed every few seconds.

    Each micro-batch writes what has changed; ``latest_recount`` merges. Every ``compact_every`` batches the
    table is written whole, and then windows that ended more than ``keep`` before the newest go; by default
    all stay. A window older than the watermark is not counted any more.
    """
    counts = decoded_counts(messages, latest_window=False).withWatermark("window_end", watermark)
    refreshed = counts.groupBy(*RECOUNT_KEYS).agg(F.sum("count").alias("count"))

    def kept(rows: DataFrame) -> DataFrame:
        newest = rows.agg(F.max(F.unix_micros("window_end"))).first()[0]
        return rows if newest is None else rows.where(F.unix_micros("window_end") > newest - micros(keep))

    def write(batch: DataFrame, batch_id: int) -> None:
        upserts.upsert(batch, path, batch_id, RECOUNT_KEYS, compact_every, None if keep is None else kept)

    return (
        refreshed.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or every(REFRESH_INTERVAL)))
        .start()
    )


def latest_recount(spark: SparkSession, path: str) -> DataFrame:
    """The counts as last refreshed."""
    return upserts.current(spark, path, RECOUNT_KEYS).select("window_end", "handle", "count")
