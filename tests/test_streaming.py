import datetime as dt
import os
import random
import signal
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mentionflow.functions.scoring import lexicon_scorer
from mentionflow.operators import messages, posts, sentiment, windows
from mentionflow.schemas import POSTS
from mentionflow.sinks import files, ledger
from mentionflow.sources.messages import read_messages, stream_messages
from mentionflow.sources.posts import read_posts, stream_posts
from mentionflow.streaming import jobs, zero_fill
from tests.test_posts import post

START = dt.datetime(2024, 1, 1, 23, 40)
SCORER = lexicon_scorer({"good": 1, "bad": -2})


def timed_post(id, at, **kwargs):
    row = list(post(id, **kwargs))
    row[5] = at
    return tuple(row)


def random_posts(n=200, minutes=60):
    rng = random.Random(11)
    offsets = sorted(rng.randint(0, minutes * 60) for _ in range(n))
    return [
        timed_post(
            i, START + dt.timedelta(seconds=s), lang=rng.choice(["en", "en", "fr"]), repost=rng.random() < 0.2,
            mentions=rng.choices(["Ann", "ann", "BOB", "eve"], k=rng.randint(0, 3)),
            text=rng.choice(["good. so good", "bad", "plain", "..."]),
        )
        for i, s in enumerate(offsets)
    ]


@pytest.fixture
def keys(spark):
    return spark.createDataFrame([("ann",), ("bob",)], "handle_key string")


@pytest.fixture
def feed(spark, tmp_path):
    """A folder that posts are appended to, and a stream over it."""

    class Feed:
        path = str(tmp_path / "posts")
        rows = random_posts()

        def add(self, rows):
            spark.createDataFrame(rows, POSTS).coalesce(1).write.mode("append").parquet(self.path)

        def end(self):
            self.add([timed_post(-1, START + dt.timedelta(days=2), mentions=["ann"])])

        def stream(self, **options):
            return stream_posts(spark, self.path, **options)

        def batch(self):
            return posts.original_posts(spark.createDataFrame(self.rows, POSTS))

    feed = Feed()
    half = len(feed.rows) // 2
    feed.add(feed.rows[:half])
    feed.second = feed.rows[half:]
    return feed


def run(*queries):
    jobs.run_bounded(queries, 120)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("panes", [True, False])
def test_counts_over_several_runs_equal_the_batch(spark, feed, keys, tmp_path, panes):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def drain():
        counts = jobs.window_counts(feed.stream(), keys, panes=panes)
        run(jobs.start_counts(counts, out, checkpoint, jobs.AVAILABLE_NOW))

    drain()
    feed.add(feed.second)
    drain()
    feed.end()
    drain()
    batch = windows.direct_count(posts.counted_mentions(feed.batch(), keys))
    expected = messages.count_messages(batch)
    found = read_messages(spark, out)
    assert bag(found.select(*expected.columns)) == bag(expected)
    offsets = sorted(r.offset for r in found.select("offset").collect())
    assert offsets == list(range(len(offsets)))  # over three runs, none missing and none twice


def test_late_posts_are_dropped_once_their_window_is_out(spark, feed, keys, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def drain():
        counts = jobs.window_counts(feed.stream(), keys, watermark="1 minute")
        run(jobs.start_counts(counts, out, checkpoint, jobs.AVAILABLE_NOW))

    feed.end()
    drain()
    before = bag(read_messages(spark, out))
    feed.add([timed_post(9_999, START, mentions=["ann"])])
    drain()
    assert before and bag(read_messages(spark, out)) == before


def test_union_of_streams_is_counted_together(spark, feed, keys, tmp_path):
    feed.end()
    both = posts.union_sources(feed.stream(), feed.stream())
    counts = jobs.window_counts(both, keys, "5 minutes", "5 minutes")
    out = str(tmp_path / "out")
    run(jobs.start_counts(counts, out, str(tmp_path / "c"), jobs.AVAILABLE_NOW))
    first_half = posts.original_posts(spark.createDataFrame(feed.rows[: len(feed.rows) // 2], POSTS))
    expected = windows.sliding_count(posts.counted_mentions(first_half, keys), "5 minutes", "5 minutes")
    found = messages.decoded_counts(read_messages(spark, out), latest_window=False)
    assert found.agg(F.sum("count")).first()[0] == 2 * expected.agg(F.sum("count")).first()[0]


def test_sentiment_messages_over_several_runs_equal_the_batch(spark, feed, keys, tmp_path):
    table, out, report = (str(tmp_path / n) for n in ("table", "out", "report"))

    def drain():
        run(jobs.start_scored_table(feed.stream(), keys, table, str(tmp_path / "c1"), SCORER, trigger=jobs.AVAILABLE_NOW))
        outputs = [
            jobs.sentiment_output(table, out, max_records=3),
            jobs.sentiment_report_output(table, report),
        ]
        counts = jobs.scored_table_counts(spark, table)
        run(jobs.start_outputs(counts, outputs, str(tmp_path / "c2"), jobs.AVAILABLE_NOW))

    drain()
    feed.add(feed.second)
    drain()
    feed.end()
    drain()

    def rows(built):
        flat = F.explode(F.from_json("value", messages.SENTIMENT_VALUE)).alias("r")
        return bag(built.select("key", "window_start", flat).select("key", "window_start", "r.tweet.id", "r.cat"))

    scored = sentiment.scored_mentions(feed.batch(), keys, SCORER)
    expected = messages.sentiment_messages(sentiment.sentiment_groups(scored))
    assert rows(spark.read.parquet(out)) == rows(expected)

    lines = [r.value for r in spark.read.text(report).collect()]
    n_windows = expected.select("window_start").distinct().count()
    assert lines.count("_" * 72) == n_windows
    records = expected.select("window_start", F.explode(F.from_json("value", messages.SENTIMENT_VALUE)).alias("r"))
    n_lines = records.select("window_start", "r.tweet.id").distinct().count()
    assert sum(line.startswith("    [") for line in lines) == n_lines


def test_several_outputs_from_one_stream(spark, feed, keys, tmp_path):
    feed.add(feed.second)
    feed.end()
    out, report = str(tmp_path / "out"), str(tmp_path / "report")
    counts = jobs.window_counts(feed.stream(), keys)
    outputs = [jobs.count_output(out), jobs.top_k_output(report, k=2)]
    run(jobs.start_outputs(counts, outputs, str(tmp_path / "c"), jobs.AVAILABLE_NOW))
    batch = windows.sliding_count(posts.counted_mentions(feed.batch(), keys))
    top = windows.top_k(batch, 2)
    lines = [r.value for r in spark.read.text(report).collect()]
    assert sum(" -> @" in line for line in lines) == top.count()
    assert spark.read.parquet(out).count() == batch.count()


def test_a_repeated_batch_replaces_itself(spark, keys, tmp_path):
    frame = spark.createDataFrame(
        [(START, START, "ann", 3)], "window_start timestamp, window_end timestamp, mention string, count long"
    )
    out, report = str(tmp_path / "out"), str(tmp_path / "report")
    for _ in range(2):
        jobs.count_output(out)(frame, 7)
        jobs.top_k_output(report)(frame, 7)
    assert spark.read.parquet(out).count() == 1
    assert sum(" -> @ann" in r.value for r in spark.read.text(report).collect()) == 1


def test_consumer_takes_what_is_there_and_goes_on_from_there(spark, keys, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("messages", "out", "c"))
    schema = "window_start timestamp, window_end timestamp, mention string, count long"

    def send(*rows):
        frame = spark.createDataFrame([(START, START + dt.timedelta(minutes=5), m, c) for m, c in rows], schema)
        messages.count_messages(frame).write.mode("append").parquet(source)

    def drain():
        stream = stream_messages(spark, source, messages.COUNT_TOPIC)
        run(jobs.start_recount(stream, out, checkpoint, trigger=jobs.AVAILABLE_NOW))
        return {r.handle: r["count"] for r in jobs.latest_recount(spark, out).collect()}

    send(("Ann", 2), ("ann", 1), ("bob", 4))
    assert drain() == {"ann": 3, "bob": 4}
    assert drain() == {"ann": 3, "bob": 4}
    send(("ANN", 10))
    assert drain() == {"ann": 13, "bob": 4}
    for n in range(3):
        send(("bob", 1))
        assert drain() == {"ann": 13, "bob": 5 + n}


def test_recounts_are_deltas_that_are_compacted(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("messages", "out", "c"))
    schema = "window_start timestamp, window_end timestamp, mention string, count long"

    def drain(day, *rows, **options):
        end = START + dt.timedelta(days=day)
        frame = spark.createDataFrame([(end - dt.timedelta(minutes=5), end, m, c) for m, c in rows], schema)
        messages.count_messages(frame).write.mode("append").parquet(source)
        stream = stream_messages(spark, source, messages.COUNT_TOPIC)
        run(jobs.start_recount(stream, out, checkpoint, trigger=jobs.AVAILABLE_NOW, compact_every=4, **options))
        return {(r.window_end.day, r.handle): r["count"] for r in jobs.latest_recount(spark, out).collect()}

    drain(0, *[(f"m{i}", 1) for i in range(500)])
    first = START.day
    for n in range(1, 4):
        found = drain(0, ("m1", n))
    assert found[first, "m1"] == 7 and len(found) == 500
    deltas = sorted((tmp_path / "out" / "delta").glob("batch_id=*"))
    assert spark.read.parquet(str(deltas[-1])).count() <= 1 and (tmp_path / "out" / "base").exists()
    whole = drain(30, ("late", 5))  # months of windows stay by default
    assert len(whole) == 501 and max(whole.values()) == 7
    for _ in range(8):
        kept = drain(30, ("late", 1), keep="7 days")
    assert [handle for _, handle in kept] == ["late"]
    assert len(list((tmp_path / "out" / "delta").glob("batch_id=*"))) <= 10
    assert len(list((tmp_path / "out" / "base").glob("batch_id=*"))) <= 2


def test_a_reader_can_start_once_the_table_has_rows(spark, feed, keys, tmp_path):
    table, out = str(tmp_path / "table"), str(tmp_path / "out")
    feed.end()
    writer = jobs.start_scored_table(
        feed.stream(), keys, table, str(tmp_path / "c1"), SCORER, trigger=jobs.every("1 second"), retention="7d"
    )
    try:
        jobs.wait_for_rows(writer, 60)
        counts = jobs.scored_table_counts(spark, table)
        output = jobs.sentiment_output(table, out)
        run(jobs.start_outputs(counts, [output], str(tmp_path / "c2"), jobs.AVAILABLE_NOW))
    finally:
        writer.stop()
    assert spark.read.parquet(out).count() > 0
    with pytest.raises(TimeoutError):
        jobs.wait_for_rows(idle(spark, tmp_path), 1)


def idle(spark, tmp_path):
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], POSTS).write.parquet(empty)
    writer = stream_posts(spark, empty).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c3"))
    return writer.trigger(**jobs.AVAILABLE_NOW).start()


def test_a_bounded_run_stops_its_queries(spark, feed, keys, tmp_path):
    counts = jobs.window_counts(feed.stream(), keys)
    query = jobs.start_counts(counts, str(tmp_path / "out"), str(tmp_path / "c"), jobs.every("1 second"))
    jobs.run_bounded([query], max_seconds=3)
    assert not query.isActive


def test_two_live_queries_end_quietly_at_the_limit(spark, feed, keys, tmp_path):
    counts = jobs.window_counts(feed.stream(), keys)
    queries = [
        jobs.start_counts(counts, str(tmp_path / f"out{i}"), str(tmp_path / f"c{i}"), jobs.every("1 second")) for i in range(2)
    ]
    jobs.run_bounded(queries, max_seconds=3)
    assert not any(q.isActive for q in queries)


def test_a_failure_of_a_later_query_is_seen_at_once(spark, feed, keys, tmp_path):
    def fail(batch, batch_id):
        raise RuntimeError("no sink")

    counts = jobs.window_counts(feed.stream(), keys)
    good = jobs.start_counts(counts, str(tmp_path / "out"), str(tmp_path / "c1"), jobs.every("1 second"))
    bad = jobs.start_outputs(counts, [fail], str(tmp_path / "c2"), jobs.AVAILABLE_NOW)
    began = time.monotonic()
    with pytest.raises(Exception, match="no sink"):
        jobs.run_bounded([good, bad], 120)
    assert not good.isActive and time.monotonic() - began < 60


def test_a_signal_stops_the_queries(spark, feed, keys, tmp_path):
    counts = jobs.window_counts(feed.stream(), keys)
    query = jobs.start_counts(counts, str(tmp_path / "out"), str(tmp_path / "c"), jobs.every("1 second"))
    earlier = signal.getsignal(signal.SIGTERM)
    timer = threading.Timer(2, os.kill, (os.getpid(), signal.SIGTERM))
    timer.start()
    began = time.monotonic()
    jobs.run_bounded([query], 120)
    assert not query.isActive and time.monotonic() - began < 60 and signal.getsignal(signal.SIGTERM) == earlier


def test_sentiment_windows_survive_a_clock_change(spark, keys, tmp_path, monkeypatch):
    """The driver is in New York, where an hour came twice on 2024-11-03 (from 05:00 to 07:00 UTC)."""
    first = dt.datetime(2024, 11, 3, 5, 0, tzinfo=dt.timezone.utc)
    rows = [timed_post(i, first + dt.timedelta(minutes=5 * i), mentions=["ann"], text=f"good {i}") for i in range(24)]
    table, out = str(tmp_path / "table"), str(tmp_path / "out")
    spark.createDataFrame(rows, POSTS).write.parquet(str(tmp_path / "posts"))
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        scored = sentiment.scored_mentions(posts.original_posts(read_posts(spark, str(tmp_path / "posts"))), keys, SCORER)
        scored.withColumn("day", F.to_date("created_at")).write.partitionBy("day").parquet(table)
        counts = windows.sliding_count(scored, "5 minutes", "5 minutes")
        jobs.sentiment_output(table, out, "5 minutes", "5 minutes")(counts, 0)
        jobs.sentiment_report_output(table, str(tmp_path / "report"), "5 minutes", "5 minutes")(counts, 0)
    finally:
        monkeypatch.undo()
        time.tzset()
    flat = messages.flattened(read_messages(spark, out))
    assert sorted(r.tweet_id for r in flat.collect()) == list(range(24))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert sum(line.startswith("    [") for line in lines) == 24


def test_a_failing_query_is_raised_and_the_others_stopped(spark, feed, keys, tmp_path):
    def fail(batch, batch_id):
        raise RuntimeError("no sink")

    counts = jobs.window_counts(feed.stream(), keys)
    good = jobs.start_counts(counts, str(tmp_path / "out"), str(tmp_path / "c1"), jobs.every("1 second"))
    bad = jobs.start_outputs(counts, [fail], str(tmp_path / "c2"), jobs.AVAILABLE_NOW)
    with pytest.raises(Exception, match="no sink"):
        jobs.run_bounded([bad, good], 60)
    assert not good.isActive


def test_offsets_of_repeated_and_mixed_batches(spark, tmp_path):
    path = str(tmp_path / "out")

    def send(batch_id, *topics):
        rows = [(topic, f"{topic}{i}", "v") for topic, n in topics for i in range(n)]
        frame = spark.createDataFrame(rows, "topic string, key string, value string").repartition(3)
        numbered = ledger.with_offsets(frame, path, batch_id)
        numbered.write.mode("overwrite").parquet(files.batch_path(path, batch_id))

    def ranges():
        found = spark.read.parquet(path)
        return {
            r.topic: (r.min_offset, r.max_offset, found.where(F.col("topic") == r.topic).select("offset").distinct().count())
            for r in messages.offset_range(found).collect()
        }

    send(0, ("a", 5), ("b", 2))
    send(1, ("a", 3))
    send(1, ("a", 3))
    assert ranges() == {"a": (0, 7, 8), "b": (0, 1, 2)}
    send(4)
    for n in range(5, 20):
        send(n, ("b", 1), ("c", 1))
    assert ranges() == {"a": (0, 7, 8), "b": (0, 16, 17), "c": (0, 14, 15)}
    assert len(list((tmp_path / "out" / "_offsets").glob("batch_id=*"))) <= ledger.ENTRIES_KEPT + 1


def lagging(spark, tmp_path):
    """Two folders read file by file; the second is half an hour behind."""
    sources, rows = [], []
    for n, parts in (("a", [(60, 120)]), ("b", [(0, 10), (10, 30), (30, 90)])):
        path = str(tmp_path / n)
        for low, high in parts:
            mine = [timed_post(1000 * len(rows) + m, START + dt.timedelta(minutes=m), mentions=["ann"]) for m in range(low, high, 2)]
            rows += mine
            spark.createDataFrame(mine, POSTS).coalesce(1).write.mode("append").parquet(path)
        end = timed_post(-1, START + dt.timedelta(days=2), mentions=["ann"])
        spark.createDataFrame([end], POSTS).coalesce(1).write.mode("append").parquet(path)
        sources.append(stream_posts(spark, path, maxFilesPerTrigger="1"))
    return sources, spark.createDataFrame(rows, POSTS)


@pytest.mark.parametrize("policy", ["min", "max"])
def test_a_source_that_is_behind_sets_the_time(spark, keys, tmp_path, policy):
    sources, batch = lagging(spark, tmp_path)
    name = "spark.sql.streaming.multipleWatermarkPolicy"
    spark.conf.set(name, policy)
    try:
        both = posts.union_sources(*sources, watermark="10 minutes")
        counts = jobs.window_counts(both, keys, "5 minutes", "5 minutes", watermark=None)
        run(jobs.start_counts(counts, str(tmp_path / "out"), str(tmp_path / "c"), jobs.AVAILABLE_NOW))
    finally:
        spark.conf.unset(name)
    found = messages.decoded_counts(read_messages(spark, str(tmp_path / "out")), latest_window=False)
    expected = windows.direct_count(posts.counted_mentions(posts.original_posts(batch), keys), "5 minutes", "5 minutes")
    total, every = (df.agg(F.sum("count")).first()[0] for df in (found, expected))
    assert every == batch.count()
    assert total == every if policy == "min" else total < every  # by max, what is behind is late


def test_early_counts_follow_every_batch(spark, feed, keys, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def drain():
        run(jobs.start_early_counts(feed.stream(), keys, out, checkpoint, compact_every=2, trigger=jobs.AVAILABLE_NOW))
        return bag(jobs.early_counts(spark, out).select("window_start", "window_end", "mention", "count"))

    def expected(rows):
        batch = posts.original_posts(spark.createDataFrame(rows, POSTS))
        return bag(windows.direct_count(posts.counted_mentions(batch, keys)))

    assert drain() == expected(feed.rows[: len(feed.rows) // 2])
    feed.add(feed.second)
    assert drain() == expected(feed.rows)
    assert drain() == expected(feed.rows)


def test_zeros_come_out_as_time_goes_on(spark, feed, keys, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def drain(expiry):
        counts = jobs.window_counts(feed.stream(), keys, "5 minutes", "5 minutes", timed=True)
        run(jobs.start_table(zero_fill.zero_filled_stream(counts, "5 minutes", expiry=expiry), out, checkpoint, jobs.AVAILABLE_NOW))
        return bag(spark.read.parquet(out))

    drain("3 hours")
    feed.add(feed.second)
    drain("3 hours")
    feed.end()
    found = drain("3 hours")
    counts = windows.direct_count(posts.counted_mentions(feed.batch(), keys), "5 minutes", "5 minutes")
    batch = bag(windows.zero_filled(counts, "5 minutes"))
    last = max(r[0] for r in batch)
    assert Counter({r: n for r, n in found.items() if r[0] <= last}) == batch
    after = [r for r in found if r[0] > last]
    assert after and all(r[3] == 0 for r in after) and max(found.values()) == 1
    for mention in {r[2] for r in batch}:  # forgotten three hours after its last count
        seen = max(r[0] for r in batch if r[2] == mention and r[3] > 0)
        assert max(r[0] for r in found if r[2] == mention) == seen + dt.timedelta(hours=3)


def test_a_stop_lets_the_running_batch_end(spark, feed, keys, tmp_path):
    out = str(tmp_path / "out")
    began, ended = [], []

    def slow(batch, batch_id):
        began.append(batch_id)
        time.sleep(3)
        batch.write.mode("overwrite").parquet(files.batch_path(out, batch_id))
        ended.append(batch_id)

    counts = jobs.window_counts(feed.stream(), keys)
    query = jobs.start_outputs(counts, [slow], str(tmp_path / "c"), jobs.every("1 hour"))
    while not began:
        time.sleep(0.05)
    jobs.run_bounded([query], max_seconds=0.2)
    assert not query.isActive and ended == began
    assert files.written_batches(spark, out) == ended
    feed.add(feed.second)
    again = jobs.start_outputs(counts, [slow], str(tmp_path / "c"), jobs.every("1 hour"))
    while len(began) == len(ended):
        time.sleep(0.05)
    at = time.monotonic()
    jobs.run_bounded([again], max_seconds=0.1, drain_seconds=0.5)  # a bound that is too short for it
    assert not again.isActive and time.monotonic() - at < 30
