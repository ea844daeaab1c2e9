"""Keyed JSON messages: building them, reading them back and adding them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionflow.functions.times import from_epoch_millis
from mentionflow.schemas import COUNT_VALUE, SENTIMENT_VALUE

# Topic names.
COUNT_TOPIC = "top-counts"
SENTIMENT_TOPIC = "sentiment"


def count_messages(counts: DataFrame, topic: str = COUNT_TOPIC) -> DataFrame:
    """One message per window and mention, value ``{"count":n,"value":mention}``."""
    value = F.to_json(F.struct("count", F.col("mention").alias("value")))
    return counts.select(
        F.lit(topic).alias("topic"), F.col("mention").alias("key"), value.alias("value"),
        "window_start", "window_end",
    )


def sentiment_messages(groups: DataFrame, topic: str = SENTIMENT_TOPIC) -> DataFrame:
    """One message per array of records, value a JSON array of the records."""
    value = F.to_json("records", {"ignoreNullFields": "false"})
    return groups.select(
        F.lit(topic).alias("topic"), F.col("mention").alias("key"), value.alias("value"),
        "window_start", "window_end", "part", "parts",
    )


def decoded(value: Column) -> Column:
    """The UTF-8 bytes of a message as text."""
    return F.decode(value, "UTF-8")


# What a message says about itself besides its value; on a broker these are headers.
HEADERS = {"window_start": "long", "window_end": "long", "part": "int", "parts": "int"}


def to_topic(messages: DataFrame) -> DataFrame:
    """(topic, key, value, headers) as a broker takes them. Windows, in microseconds, and parts
    go into headers, so a reader can tell the messages of one key apart."""
    headers = []
    for name in HEADERS:
        if name in messages.columns:
            value = F.unix_micros(name) if name.startswith("window") else F.col(name)
            headers.append(F.struct(F.lit(name).alias("key"), F.encode(value.cast("string"), "UTF-8").alias("value")))
    return messages.select("topic", "key", "value", F.array(*headers).alias("headers"))


def from_topic(raw: DataFrame) -> DataFrame:
    """Messages from broker rows (topic, key, value, headers, offset), the bytes decoded. The
    broker's own timestamp says when a message came in, not which window it is about."""

    def header(name: str) -> Column:
        found = F.filter("headers", lambda h: h["key"] == name)
        return decoded(F.get(found, F.lit(0))["value"]).cast(HEADERS[name])

    windows = [F.timestamp_micros(header(n)).alias(n) for n in ("window_start", "window_end")]
    return raw.select(
        "topic", decoded(F.col("key")).alias("key"), decoded(F.col("value")).alias("value"), *windows,
        header("part").alias("part"), header("parts").alias("parts"), "offset",
    )


def lenient_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds the ``parsed`` value (a VARIANT), or NULL where the text is not JSON, and
    ``is_valid``; the text itself stays in its column. Never fails."""
    parsed = df.withColumn("parsed", F.try_parse_json(F.col(value)))
    return parsed.withColumn("is_valid", F.col("parsed").isNotNull())


def flattened(messages: DataFrame) -> DataFrame:
    """One flat row per record of the sentiment messages; other columns are dropped."""
    records = messages.select(F.explode(F.from_json("value", SENTIMENT_VALUE)).alias("r"))
    return records.select(
        F.col("r.mention").alias("mention"),
        F.col("r.cat").alias("cat"),
        F.col("r.polarity").alias("polarity"),
        F.col("r.tweet.id").alias("tweet_id"),
        from_epoch_millis(F.col("r.tweet.created_at")).alias("tweet_created_at"),
        F.col("r.tweet.text").alias("tweet_text"),
    )


def decoded_counts(messages: DataFrame, latest_window: bool = True) -> DataFrame:
    """(handle, count, window_end) of the count messages; by default of the last window only,
    since windows overlap and adding them all up counts a post several times."""
    if latest_window:
        last = messages.select(F.max("window_end").alias("m")).scalar()
        messages = messages.where(F.col("window_end") == last)
    value = F.from_json("value", COUNT_VALUE)
    return messages.select(value.alias("v"), "window_end").select(
        F.lower("v.value").alias("handle"), F.col("v.count").alias("count"), "window_end"
    )


def recount(messages: DataFrame, latest_window: bool = True) -> DataFrame:
    """Counts per handle, spellings folded together."""
    counts = decoded_counts(messages, latest_window)
    return counts.groupBy("handle").agg(F.sum("count").alias("count"))


def recount_total(messages: DataFrame, latest_window: bool = True) -> DataFrame:
    return decoded_counts(messages, latest_window).agg(F.sum("count").alias("total"))


def offset_range(messages: DataFrame) -> DataFrame:
    """Smallest and largest offset read, per topic."""
    return messages.groupBy("topic").agg(
        F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset")
    )
