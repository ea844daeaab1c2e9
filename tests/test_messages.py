import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mentionflow.functions.scoring import lexicon_scorer
from mentionflow.operators import messages, posts, sentiment
from mentionflow.schemas import POSTS
from mentionflow.sinks.files import write_messages
from mentionflow.sources.messages import read_messages
from tests.test_posts import post

START, END = dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 0, 5)


@pytest.fixture
def counts(spark):
    rows = [
        (START, END, "United", 3), (START, END, "united", 2), (START, END, "klm", 1),
        (START - dt.timedelta(minutes=1), END - dt.timedelta(minutes=1), "united", 50),
    ]
    return spark.createDataFrame(rows, "window_start timestamp, window_end timestamp, mention string, count long")


def test_count_messages_are_compact_json(counts):
    found = messages.count_messages(counts).where("key = 'klm'").first()
    assert (found.topic, found.value) == ("top-counts", '{"count":1,"value":"klm"}')


def test_recount_folds_case_and_takes_the_last_window(spark, counts, tmp_path):
    write_messages(messages.count_messages(counts), path=str(tmp_path / "m"))
    stored = read_messages(spark, str(tmp_path / "m"), messages.COUNT_TOPIC)
    assert {tuple(r) for r in messages.recount(stored).collect()} == {("united", 5), ("klm", 1)}
    assert messages.recount_total(stored).first().total == 6
    assert messages.recount_total(stored, latest_window=False).first().total == 56


def as_received(sent):
    """Broker rows of sent messages: bytes, and the broker's own time and offsets."""
    return sent.select(
        "topic", F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), "headers",
        (F.lit(1_700_000_000_000) + F.monotonically_increasing_id()).alias("ms"), F.monotonically_increasing_id().alias("offset"),
    ).withColumn("timestamp", F.timestamp_millis("ms"))


def test_messages_carry_their_window_over_a_broker(spark, counts, tmp_path):
    received = messages.from_topic(as_received(messages.to_topic(messages.count_messages(counts))))
    assert {(r.key, r.window_start, r.window_end) for r in received.collect()} >= {("klm", START, END)}
    assert {tuple(r) for r in messages.recount(received).collect()} == {("united", 5), ("klm", 1)}
    write_messages(received, path=str(tmp_path / "m"))
    stored = read_messages(spark, str(tmp_path / "m"))
    offsets = [r.offset for r in received.collect()]
    assert tuple(messages.offset_range(stored).first()) == ("top-counts", min(offsets), max(offsets))


def test_a_split_group_can_be_put_together_again(spark):
    rows = [post(i, mentions=["klm"], text=f"good {i}") for i in range(10)]
    keys = spark.createDataFrame([("klm",)], "handle_key string")
    scored = sentiment.scored_mentions(spark.createDataFrame(rows, POSTS), keys, lexicon_scorer({"good": 1}))
    groups = sentiment.sentiment_groups(scored, "5 minutes", "5 minutes", max_records=3)
    received = messages.from_topic(as_received(messages.to_topic(messages.sentiment_messages(groups)))).collect()
    assert {(r.key, r.window_start, r.parts) for r in received} == {("klm", received[0].window_start, received[0].parts)}
    assert received[0].parts > 1 and len({r.part for r in received}) == len(received)
    ids = sorted(x["tweet"]["id"] for r in received for x in json.loads(r.value))
    assert ids == list(range(10))


def test_own_messages_have_offsets(spark, counts, tmp_path):
    write_messages(messages.count_messages(counts), path=str(tmp_path / "m"))
    found = [r.offset for r in read_messages(spark, str(tmp_path / "m")).collect()]
    assert None not in found and len(set(found)) == 4


def test_sentiment_messages_round_trip(spark):
    rows = [
        post(1, mentions=["United", "united"], text='say "good" é\n'),
        post(2, mentions=["klm", "united"], text="..."),
        post(1, mentions=["United", "united"], text='say "good" é\n'),
    ]
    keys = spark.createDataFrame([("united",), ("klm",)], "handle_key string")
    scored = sentiment.scored_mentions(spark.createDataFrame(rows, POSTS), keys, lexicon_scorer({"good": 1}))
    built = messages.sentiment_messages(sentiment.sentiment_groups(scored, "5 minutes", "5 minutes"))
    by_key = {r.key: json.loads(r.value) for r in built.collect()}
    one = {
        "tweet": {"id": 1, "created_at": 1454839872345, "text": 'say "good" é\n'},
        "mention": "united", "cat": "+", "polarity": 3.0,
    }
    assert by_key["united"][0] == one
    assert by_key["klm"][0]["polarity"] is None and by_key["klm"][0]["cat"] is None
    flat = {(r.mention, r.tweet_id): r for r in messages.flattened(built).collect()}
    assert set(flat) == {("united", 1), ("united", 2), ("klm", 2)}
    assert messages.flattened(built).count() == 3
    assert flat["united", 1].tweet_text == 'say "good" é\n'
    assert flat["united", 1].tweet_created_at == dt.datetime(2016, 2, 7, 10, 11, 12, 345000)


def test_strict_mode_puts_a_text_without_sentences_into_plus(spark):
    frame = spark.createDataFrame([post(2, text="...")], POSTS)
    assert sentiment.scored_posts(frame, strict_reference=True).first().cat == "+"
    assert sentiment.scored_posts(frame).first().cat is None


def test_a_post_is_scored_before_it_is_copied_to_its_handles(spark):
    keys = spark.createDataFrame([("united",)], "handle_key string")
    scored = sentiment.scored_mentions(spark.createDataFrame([post(1)], POSTS), keys)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(hits") < plan.index("regexp_replace(")


def test_lenient_json_keeps_the_text(spark):
    raw = spark.createDataFrame([('{"a": 1}',), ("{broken",), ("",), ("[1, 2]",), (None,)], "value string")
    found = messages.lenient_json(raw).select("value", F.to_json("parsed").alias("p"), "is_valid").collect()
    assert [tuple(r) for r in found] == [
        ('{"a": 1}', '{"a":1}', True), ("{broken", None, False), ("", None, False), ("[1, 2]", "[1,2]", True),
        (None, None, False),
    ]


def test_offsets_and_decoding(spark):
    log = spark.createDataFrame([("a", 5), ("a", 2), ("b", 9)], "topic string, offset long")
    assert {tuple(r) for r in messages.offset_range(log).collect()} == {("a", 2, 5), ("b", 9, 9)}
    raw = spark.createDataFrame([(bytearray("é🎉", "utf-8"),)], "value binary")
    assert raw.select(messages.decoded(F.col("value"))).first()[0] == "é🎉"


def test_emitted_post_keeps_milliseconds(spark):
    frame = spark.createDataFrame([post(1)], POSTS)
    assert frame.select(posts.emitted_post().alias("p")).first().p.created_at == 1454839872345
