import datetime as dt

from mentionflow import session
from mentionflow.operators import windows
from mentionflow.schemas import POSTS
from mentionflow.sources.posts import stream_posts
from mentionflow.streaming import jobs
from tests.test_posts import post


def test_initial_partitions_follow_the_shuffled_size(spark):
    assert session.initial_partitions(0) == 200
    assert session.initial_partitions(10 * 2**40) == 40_960
    assert session.initial_partitions(100 * 2**40) == 50_000
    before = spark.conf.get(session.INITIAL_PARTITIONS, None)
    with session.shuffling(spark, 300 * 2**28):
        assert spark.conf.get(session.INITIAL_PARTITIONS) == "300"
    assert spark.conf.get(session.INITIAL_PARTITIONS, None) == before


def test_stored_rows_keep_schema_and_values(spark):
    df = spark.createDataFrame([post(1, mentions=["a"])], POSTS)
    back = session.stored(df, "rows")
    assert back.schema == POSTS and back.first() == df.first()


def test_counts_with_state_in_rocksdb(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    rows = [post(i, mentions=["ann"]) for i in range(3)] + [post(9, mentions=["ann"])]
    late = list(rows[-1])
    late[5] += dt.timedelta(days=1)
    path = str(tmp_path / "posts")
    spark.createDataFrame([*rows[:3], tuple(late)], POSTS).write.parquet(path)
    keys = spark.createDataFrame([("ann",)], "handle_key string")
    spark.conf.set(provider, session.ROCKSDB)
    try:
        counts = jobs.window_counts(stream_posts(spark, path), keys)
        out = str(tmp_path / "out")
        jobs.run_bounded([jobs.start_counts(counts, out, str(tmp_path / "c"), jobs.AVAILABLE_NOW)], 60)
    finally:
        spark.conf.set(provider, before)
    assert [r.value for r in spark.read.parquet(out).collect()] == ['{"count":3,"value":"ann"}'] * 5
    assert windows.WINDOW == "5 minutes" and windows.SLIDE == "1 minute"
