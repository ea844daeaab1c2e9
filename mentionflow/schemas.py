"""Explicit schemas; nothing is inferred on a stream."""

from __future__ import annotations

from pyspark.sql import types as T

GEO = T.StructType(
    [T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]
)

USER = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])

POSTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("user", USER),
        T.StructField("place", T.StringType()),
        T.StructField("geo", GEO),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("retweet_count", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("is_truncated", T.BooleanType()),
        T.StructField("is_retweet", T.BooleanType()),
        T.StructField("mentions", T.ArrayType(T.StringType())),
    ]
)

# A post as it is emitted; created_at is in milliseconds since the epoch.
EMITTED_POST = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

COUNT_VALUE = T.StructType(
    [T.StructField("count", T.LongType()), T.StructField("value", T.StringType())]
)

SENTIMENT_RECORD = T.StructType(
    [
        T.StructField("tweet", EMITTED_POST),
        T.StructField("mention", T.StringType()),
        T.StructField("cat", T.StringType()),
        T.StructField("polarity", T.DoubleType()),
    ]
)

SENTIMENT_VALUE = T.ArrayType(SENTIMENT_RECORD)

# Keyed messages as a table; window and part columns say where a message comes from.
MESSAGES = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("parts", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

LABELLED = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("polarity", T.StringType())]
)

SCORED = T.StructType(LABELLED.fields + [T.StructField("sentiment", T.DoubleType())])
