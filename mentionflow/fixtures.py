"""The driver tables seen as posts, dictionary, lexicon and labelled texts.

Posts are the events, each with the text and language of a document. All rows of both tables
and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionflow.session import use_utc
from mentionflow.sources.dictionary import handle_keys, handles

DICTIONARY_LINES = [
    "Click Clothing,@Click",
    "View Optics,@View",
    "Purchase Partners,@Purchase",
    "no handle,",
    "too,many,fields",
]

# Words that occur in the documents.
LEXICON = {
    "with": 1, "for": 1, "this": 1, "by": 2, "be": 1, "was": -1, "that": -1, "from": -1,
    "on": -1, "at": -2, "trash": -2, "worthless": -2, "idiot": -2, "moron": -2,
    "pathetic": -2, "clown": -1, "disgusting": -2, "loser": -2, "stupid": -2,
}

STOP_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "be",
    "by", "as", "this", "are", "at", "from",
]

REPOST_SOURCE = "src3"
TRUNCATED_CHARS = 5_000

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of a few splits is spread over the cores, as it is one row group
    and scoring it would be one task."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet")


def posts_of(events: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """Posts from events (batch or streaming) and the n documents, numbered from 0.

    The handle is the event type, in capitals if the event's number k is 50 or more and once
    more in small letters if it is 80 or more; then comes the user.
    """
    numbered = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    first = F.when(k >= 50, F.upper("event_type")).otherwise(F.col("event_type"))
    user_handle = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    handles = F.when(k >= 80, F.array(first, F.col("event_type"), user_handle)).otherwise(
        F.array(first, user_handle)
    )
    mentions = F.col("mentions")
    party = F.when(F.col("event_type") == "purchase", " \U0001f389").otherwise("")
    text = F.concat(F.concat_ws(" ", F.transform(mentions, lambda m: F.concat(F.lit("@"), m))), F.lit(" "), F.col("text"), party)
    is_error, is_click, is_view = [F.col("event_type") == t for t in ("error", "click", "view")]
    user = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"))
    geo = F.struct(F.col("value").alias("latitude"), (-F.col("value")).alias("longitude"))
    mentioning = numbered.withColumns({"mentions": handles, "doc_id": F.col("event_id") % n})
    joined = mentioning.join(documents, "doc_id")
    return joined.select(
        F.col("event_id").alias("id"),
        "lang",
        F.when(~is_error, user).alias("user"),
        F.when(is_view, F.col("source")).alias("place"),
        F.when(is_click, geo).alias("geo"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("k").alias("retweet_count"),
        text.alias("text"),
        (F.col("n_chars") > TRUNCATED_CHARS).alias("is_truncated"),
        (F.col("source") == REPOST_SOURCE).alias("is_retweet"),
        "mentions",
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").count()
    return posts_of(table(spark, sf_dir, "events"), documents(spark, sf_dir), n)


def post_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").count()
    return posts_of(event_stream(spark, sf_dir), documents(spark, sf_dir), n)


def dictionary_lines(spark: SparkSession) -> DataFrame:
    lines = F.array(*[F.lit(line) for line in DICTIONARY_LINES])
    return spark.range(1).select(F.explode(lines).alias("value"))


def dictionary(spark: SparkSession) -> DataFrame:
    return handles(dictionary_lines(spark))


def keys(spark: SparkSession) -> DataFrame:
    return handle_keys(dictionary_lines(spark))


def lexicon(spark: SparkSession) -> DataFrame:
    entries = [F.struct(F.lit(w).alias("word"), F.lit(n).alias("weight")) for w, n in LEXICON.items()]
    return spark.range(1).select(F.inline(F.array(*entries)))


def label_word() -> Column:
    quality, toxic = F.col("quality"), F.col("toxic")
    return F.when(quality == 0, "Negative").when(toxic == 1, "neutral").otherwise("POSITIVE")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, airline_sentiment, text) of the labelled documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", label_word().alias("airline_sentiment"), "text")
