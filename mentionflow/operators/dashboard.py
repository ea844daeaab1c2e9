"""Aggregates behind the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_per_handle(handles: DataFrame, counts: DataFrame) -> DataFrame:
    """Every dictionary handle with its count, 0 if it was not mentioned.

    ``handles`` have ``handle`` and ``handle_key``; ``counts`` have ``mention`` and ``count``,
    in any spelling.
    """
    folded = counts.groupBy(F.lower("mention").alias("handle_key")).agg(F.sum("count").alias("count"))
    return handles.join(folded, "handle_key", "left").select(
        "handle", F.coalesce("count", F.lit(0)).alias("count")
    )


def positive_negative(
    records: DataFrame, since: Column | None = None, until: Column | None = None
) -> DataFrame:
    """Positive and negative records per mention, and a ``Total`` row.

    The period is half open, on ``created_at``. Rows are counted per mention first; only
    those few counts go through the rollup.
    """
    if since is not None:
        records = records.where(F.col("created_at") >= since)
    if until is not None:
        records = records.where(F.col("created_at") < until)
    per_mention = records.groupBy("mention").agg(
        F.count_if(F.col("cat") == "+").alias("p"), F.count_if(F.col("cat") == "-").alias("n")
    )
    rolled = per_mention.rollup("mention").agg(
        F.grouping("mention").alias("g"), F.sum("p").alias("positive"), F.sum("n").alias("negative")
    )
    name = F.when(F.col("g") == 1, "Total").otherwise(F.col("mention"))
    return rolled.select(name.alias("index"), "positive", "negative", (F.col("g") == 1).alias("is_total"))
