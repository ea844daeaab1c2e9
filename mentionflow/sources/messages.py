"""Scans of keyed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionflow.operators.messages import from_topic
from mentionflow.schemas import MESSAGES


def read_messages(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """All messages of a message table."""
    found = spark.read.schema(MESSAGES).parquet(path).select(*MESSAGES.names)
    return found if topic is None else found.where(F.col("topic") == topic)


def stream_messages(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """Messages of a message table as they arrive. A query over them with a checkpoint and an
    availableNow trigger takes what is there, and the next run goes on where it stopped."""
    found = spark.readStream.schema(MESSAGES).parquet(path).select(*MESSAGES.names)
    return found if topic is None else found.where(F.col("topic") == topic)


def topic_messages(spark: SparkSession, topic: str, streaming: bool = True, **options: str) -> DataFrame:
    """Messages of a broker topic; needs the Kafka connector on the class path."""
    reader = spark.readStream if streaming else spark.read
    return from_topic(reader.format("kafka").options(subscribe=topic, includeHeaders="true", **options).load())
