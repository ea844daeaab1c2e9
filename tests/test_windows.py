import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mentionflow.functions.times import micros
from mentionflow.operators import windows

EPOCH = dt.datetime(1970, 1, 1)


def random_mentions(n=300, span_minutes=90, seed=3):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1, 23, 10)
    names = ["a", "A", "b", "c", *["hot"] * 4]
    return [
        (i, rng.choice(names), start + dt.timedelta(seconds=rng.randint(0, span_minutes * 60)))
        for i in range(n)
    ]


def brute_counts(rows, window, slide):
    counts = Counter()
    w, s = micros(window), micros(slide)
    for _, mention, at in rows:
        t = (at - EPOCH) // dt.timedelta(microseconds=1)
        start = t - t % s
        while start > t - w:
            counts[(EPOCH + dt.timedelta(microseconds=start), mention)] += 1
            start -= s
    return counts


def as_counter(df):
    shown = df.select(F.col("window_start").cast("timestamp_ntz"), "mention", "count")
    return Counter({(r[0], r[1]): r[2] for r in shown.collect()})


@pytest.fixture
def mentions(spark):
    return spark.createDataFrame(random_mentions(), "id long, mention string, created_at timestamp_ntz").withColumn(
        "created_at", F.col("created_at").cast("timestamp")
    )


SIZES = [
    ("5 minutes", "1 minute"), ("5 minutes", "5 minutes"), ("5 minutes", "2 minutes"), ("1 hour", "15 minutes"),
]


@pytest.mark.parametrize(("window", "slide"), SIZES)
def test_panes_and_direct_counts_equal_brute_force(mentions, window, slide):
    expected = brute_counts(random_mentions(), window, slide)
    assert as_counter(windows.direct_count(mentions, window, slide)) == expected
    assert as_counter(windows.sliding_count(mentions, window, slide)) == expected


def test_boundary_rows_belong_to_the_window_they_start(spark):
    at = dt.datetime(2024, 1, 1, 0, 5)
    rows = spark.createDataFrame([(1, "a", at)], "id long, mention string, created_at timestamp")
    found = [r.window_start for r in windows.sliding_count(rows, "5 minutes", "5 minutes").collect()]
    assert found == [at]


def test_panes_copy_counts_not_rows(mentions):
    plan = windows.sliding_count(mentions)._jdf.queryExecution().executedPlan().toString()
    # The copying Expand stands above the first aggregation.
    assert plan.index("Expand") < plan.index("functions=[count(1)]")


def test_zero_fill_covers_every_later_slot(mentions):
    counts = windows.sliding_count(mentions)
    expected = brute_counts(random_mentions(), "5 minutes", "1 minute")
    last = max(start for start, _ in expected)
    filled = {}
    for mention in {m for _, m in expected}:
        slot = min(s for s, m in expected if m == mention)
        while slot <= last:
            filled[(slot, mention)] = expected.get((slot, mention), 0)
            slot += dt.timedelta(minutes=1)
    found = windows.zero_filled(counts)
    shown = found.select(F.col("window_start").cast("timestamp_ntz"), "mention", "count")
    assert {(r[0], r[1]): r[2] for r in shown.collect()} == filled
    assert found.where("window_end != window_start + INTERVAL 5 MINUTES").count() == 0


@pytest.mark.parametrize("zone", ["UTC", "+05:30"])
@pytest.mark.parametrize(("window", "slide", "panes"), [("21 minutes", "7 minutes", 3), ("2 days", "2 days", 1), ("1 day", "6 hours", 4)])
def test_zero_fill_keeps_all_counts(spark, mentions, monkeypatch, zone, window, slide, panes):
    monkeypatch.setattr(windows, "SLOTS", 3)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        counts = windows.sliding_count(mentions, window, slide)
        filled = windows.zero_filled(counts, slide)
        sums = [df.agg(F.sum("count"), F.count_if(F.col("count") > 0)).first() for df in (counts, filled)]
        assert sums[0] == sums[1] and sums[0][0] == panes * mentions.count()
        assert filled.groupBy("mention", "window_start").count().where("count > 1").count() == 0
        gap = F.unix_micros("window_start") - F.lag(F.unix_micros("window_start")).over(Window.partitionBy("mention").orderBy("window_start"))
        assert filled.select(gap.alias("gap")).where("gap is not null").distinct().count() <= 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_top_k_is_a_part_of_the_counts_with_fixed_ties(spark):
    counts = spark.createDataFrame(
        [("w1", "e", m, c) for m, c in [("b", 2), ("a", 2), ("c", 5), ("z", 0)]] + [("w2", "e", "z", 0)],
        "window_start string, window_end string, mention string, count long",
    )
    found = windows.top_k(counts, 2).orderBy("window_start", "rank").collect()
    assert [(r.window_start, r.mention, r["count"], r["rank"]) for r in found] == [
        ("w1", "c", 5, 1), ("w1", "a", 2, 2)
    ]
    assert [r.mention for r in windows.top_k_overall(counts, 3).collect()] == ["c", "a", "b"]
    assert [r.mention for r in windows.descending(counts).collect()] == ["c", "a", "b", "z", "z"]


def test_top_k_limits_before_the_shuffle(mentions):
    plan = windows.top_k(windows.sliding_count(mentions))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
