import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mentionflow.operators import collect
from tests.test_windows import random_mentions

FIVE, ONE = "5 minutes", "1 minute"


@pytest.fixture
def rows(spark):
    raw = random_mentions(400, 60) + random_mentions(400, 60)[:50]  # some posts come twice
    df = spark.createDataFrame(raw, "id long, mention string, created_at timestamp_ntz")
    return df.withColumn("created_at", F.col("created_at").cast("timestamp")).repartition(3)


def record():
    return F.struct("id", F.col("created_at").alias("at"))


def members(groups, key="mention"):
    flat = groups.select("window_start", key, F.explode("records.id").alias("id"))
    return Counter(tuple(r) for r in flat.collect())


def direct(rows, distinct, window=FIVE, slide=ONE):
    placed = collect.windowed(rows, window, slide).select("window_start", "mention", "id")
    return Counter(tuple(r) for r in (placed.distinct() if distinct else placed).collect())


@pytest.mark.parametrize("distinct", [True, False])
@pytest.mark.parametrize("max_records", [1_000, 7])
def test_blocks_hold_exactly_the_rows_of_each_window(rows, distinct, max_records):
    groups = collect.sliding_collect(rows, record(), distinct=distinct, max_records=max_records)
    assert members(groups) == direct(rows, distinct)


@pytest.mark.parametrize(("window", "slide"), [(FIVE, FIVE), (FIVE, "2 minutes"), ("1 hour", "15 minutes")])
def test_other_window_sizes(rows, window, slide):
    groups = collect.sliding_collect(rows, record(), window=window, slide=slide, max_records=20)
    assert members(groups) == direct(rows, True, window, slide)


def test_small_groups_are_one_row_and_hot_groups_are_split(rows):
    whole = collect.sliding_collect(rows, record())
    assert whole.where("parts != 1").count() == 0
    assert whole.groupBy("window_start", "mention").count().where("count > 1").count() == 0
    split = collect.sliding_collect(rows, record(), max_records=7)
    sizes = {r.mention: r.m for r in split.groupBy("mention").agg(F.max("parts").alias("m")).collect()}
    assert sizes["hot"] > 10
    assert split.agg(F.max(F.size("records"))).first()[0] <= 4 * 7


def test_hot_sizes_by_join_without_broadcast(rows):
    split = collect.sliding_collect(rows, record(), max_records=7, broadcast_rows=0)
    assert members(split) == direct(rows, True)


def test_sizes_by_block_only(rows):
    split = collect.sliding_collect(rows, record(), size_by=(), max_records=7)
    assert members(split) == direct(rows, True)


def test_many_copies_of_one_post_stay_whole(spark):
    at = dt.datetime(2024, 1, 1)
    copies = spark.range(0, 5_000, 1, 8).select(
        F.lit(1).alias("id"), F.lit("hot").alias("mention"), F.lit(at).cast("timestamp").alias("created_at")
    )
    once = collect.sliding_collect(copies, record(), max_records=100)
    assert once.agg(F.sum(F.size("records"))).first()[0] == 5  # one record in each of five windows
    every = collect.sliding_collect(copies, record(), distinct=False, max_records=100)
    assert every.agg(F.sum(F.size("records"))).first()[0] == 5 * 5_000
    assert every.agg(F.max(F.size("records"))).first()[0] < 5_000


def test_posts_before_1970(spark):
    df = spark.sql("SELECT 1L id, 'a' mention, TIMESTAMP '1969-12-31 23:59:30' created_at")
    assert members(collect.sliding_collect(df, record())) == direct(df, True)


def test_bounds_by_binary_search(spark):
    rng = random.Random(2)
    rows = [(n, sorted(rng.randint(-5, 20) for _ in range(n)), b) for n in (0, 1, 2, 3, 7, 8, 100) for b in range(-7, 23)]
    df = spark.createDataFrame(rows, "n int, at array<long>, bound long")
    items = df.withColumn("items", F.transform("at", lambda a: F.struct(a.alias("at"))))
    for r in items.select("at", "bound", collect._below(F.col("items"), F.col("bound")).alias("found")).collect():
        assert r.found == sum(a < r.bound for a in r.at)
