"""Text layouts, as rows with one ``value`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionflow.functions.labels import WORDS, bucket
from mentionflow.functions.text import fixed
from mentionflow.functions.times import micros
from mentionflow.operators.collect import windowed
from mentionflow.operators.windows import SLIDE, TOP_K, WINDOW, top_k
from mentionflow.session import checkpointed
from mentionflow.sinks.ordered import in_order, packed, unpacked

# Fixed values of the layouts.
RULE = "_" * 72
TOP_TITLE = "Top {k} handles in the last {ms} ms (non-cumulative):"
SENTIMENT_TITLE = "Tweets with sentiment in the last {ms} ms:"
TOP_LINE = "%d -> @%s"
SENTIMENT_HEADER = "  (%s)"
SENTIMENT_LINE = "[%s]: %s"
PREDICTION_LINE = "NA\t%s\t%s\t%s\t%s\t%s"
LOCATION = "GeoLocation{latitude=%s, longitude=%s}"
DATE_FORMAT = "EEE MMM dd HH:mm:ss zzz yyyy"
POST_FIELDS = 10


def _millis(window: str) -> int:
    return micros(window) // 1000


def top_k_report(counts: DataFrame, k: int = TOP_K, window: str = WINDOW) -> DataFrame:
    """One report text per window: rule, title and one line per item, largest first."""
    top = top_k(counts, k)
    line = F.format_string(TOP_LINE, "count", "mention")
    items = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))  # at most k
    lines = F.array_join(F.transform(items, lambda i: i["line"]), "\n  ")
    head = f"{RULE}\n{TOP_TITLE.format(k=k, ms=_millis(window))}\n  "
    return top.groupBy("window_start", "window_end").agg(
        F.concat(F.lit(head), lines).alias("value")
    )


def sentiment_line(score: Column, text: Column) -> Column:
    return F.format_string(SENTIMENT_LINE, fixed(score, 1), text)


def sentiment_report(
    scored: DataFrame,
    window: str = WINDOW,
    slide: str = SLIDE,
    ends: tuple | None = None,
    keep: bool = True,
) -> DataFrame:
    """The lines of the sentiment report, one row each, to be put ``in_report_order``.

    Input: posts with ``created_at``, ``id``, ``text``, ``polarity`` and ``cat``; ``ends`` keeps
    only the windows that end between its two timestamps. A line is a row of its own, so no
    window or category has to fit into one task. The scored posts are checkpointed first, in packed blocks, as the
    headings and the sort read them again; Spark drops the checkpoint with the result. ``keep`` is
    False for posts that are as quick to read again from where they are.
    """
    needed = scored.select("created_at", "id", "text", "polarity", F.coalesce("cat", F.lit("null")).alias("cat"))
    narrow = needed.drop("text")
    if keep:
        blocks = checkpointed(packed(needed))
        needed, narrow = unpacked(blocks, needed.schema), unpacked(blocks, needed.schema, narrow.columns)

    def in_windows(rows: DataFrame) -> DataFrame:
        placed = windowed(rows, window, slide)
        return placed if ends is None else placed.where(F.col("window_end").between(*ends))

    placed = in_windows(needed)
    posts = placed.select(
        "window_start", "window_end", "cat", F.lit(1).alias("level"), "polarity", "id",
        F.concat(F.lit("    "), sentiment_line(F.col("polarity"), F.col("text"))).alias("value"),
    )
    sections = checkpointed(in_windows(narrow).select("window_start", "window_end", "cat").distinct())
    none = F.lit(None)

    def heading(frame: DataFrame, category: Column, value: Column) -> DataFrame:
        return frame.select(
            "window_start", "window_end", category.alias("cat"), F.lit(0).alias("level"),
            none.cast("double").alias("polarity"), none.cast("long").alias("id"), value.alias("value"),
        )

    windows = sections.select("window_start", "window_end").distinct()
    title = F.lit(f"{RULE}\n{SENTIMENT_TITLE.format(ms=_millis(window))}")
    titles = heading(windows, F.lit(""), title)
    headers = heading(sections, F.col("cat"), F.format_string(SENTIMENT_HEADER, "cat"))
    return titles.unionByName(headers).unionByName(posts)


def in_report_order(lines: DataFrame) -> DataFrame:
    """Report lines in reading order over all partitions. Categories go +, =, -, and the best
    score comes first. Copies of one post are told apart by their input partition, so that a
    range of equal lines can be shared by many tasks."""
    section = F.when(F.col("cat") == "", 0).when(F.col("cat") == "+", 1)
    section = section.when(F.col("cat") == "=", 2).when(F.col("cat") == "-", 3).otherwise(4)
    return in_order(lines.withColumns({"section": section, "copy": F.spark_partition_id()}))


def prediction_line() -> Column:
    """``NA, uid, predicted, score, actual, text`` from uid, actual, text and score."""
    predicted = F.coalesce(bucket(F.col("score"), WORDS), F.lit("null"))
    return F.format_string(PREDICTION_LINE, "uid", predicted, fixed(F.col("score"), 2), "actual", "text")


def prediction_lines(labelled: DataFrame) -> DataFrame:
    return labelled.select(prediction_line().alias("value"))


def post_lines(posts: DataFrame) -> DataFrame:
    """Ten tab-separated fields per post, ``null`` for what is missing."""
    geo = F.when(
        F.col("geo").isNotNull(),
        F.format_string(
            LOCATION, F.col("geo.latitude").cast("string"), F.col("geo.longitude").cast("string")
        ),
    )
    fields = [
        F.col("id"), F.col("lang"), F.col("user.name"), F.col("place"), geo,
        F.unix_millis("created_at"), F.date_format("created_at", DATE_FORMAT),
        F.col("retweet_count"), F.col("text"), F.col("is_truncated"),
    ]
    assert len(fields) == POST_FIELDS
    texts = [F.coalesce(f.cast("string"), F.lit("null")) for f in fields]
    return posts.select(F.concat_ws("\t", *texts).alias("value"))
