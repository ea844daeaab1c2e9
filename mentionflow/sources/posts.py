"""Scans of posts, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionflow.schemas import POSTS


def read_posts(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.read.schema(POSTS).format(fmt).options(**options).load(path)


def stream_posts(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """New files below ``path`` as they appear."""
    return spark.readStream.schema(POSTS).format(fmt).options(**options).load(path)


_UNREADABLE = "_unreadable"


def _parsed(raw: DataFrame, value: str) -> DataFrame:
    schema = T.StructType([*POSTS.fields, T.StructField(_UNREADABLE, T.StringType())])
    post = F.from_json(value, schema, {"columnNameOfCorruptRecord": _UNREADABLE})
    return raw.withColumn("post", post)


def readable_posts(raw: DataFrame, value: str = "value") -> DataFrame:
    """The posts among JSON texts."""
    good = F.col("post").isNotNull() & F.col(f"post.{_UNREADABLE}").isNull()
    return _parsed(raw, value).where(good).select("post.*").drop(_UNREADABLE)


def unreadable_posts(raw: DataFrame, value: str = "value") -> DataFrame:
    """The other rows, whole: texts that are no JSON object, or not of a post's types."""
    bad = F.col("post").isNull() | F.col(f"post.{_UNREADABLE}").isNotNull()
    return _parsed(raw, value).where(bad).drop("post")


def topic_texts(spark: SparkSession, **options: str) -> DataFrame:
    """(value, offset) of the messages of a topic; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.decode("value", "UTF-8").alias("value"), "topic", "offset")


def posts_from_topic(spark: SparkSession, **options: str) -> DataFrame:
    """Posts as JSON messages of a topic. ``unreadable_posts`` of ``topic_texts`` are the rest."""
    return readable_posts(topic_texts(spark, **options))
