"""The dictionary of names and handles: lines of ``name,@handle`` without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Exactly two fields, where trailing empty fields do not count.
TWO_FIELDS = r"^[^,]*,[^,]+,*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _fields(lines: DataFrame) -> DataFrame:
    fields = F.split("value", ",")
    return lines.where(F.rlike("value", F.lit(TWO_FIELDS))).select(
        fields[0].alias("name"), fields[1].alias("handle")
    )


def handles(lines: DataFrame) -> DataFrame:
    """(name, handle, handle_key), handle lower-cased and handle_key without its first
    character; lines without exactly two fields are dropped."""
    low = _fields(lines).withColumn("handle", F.lower("handle"))
    return low.withColumn("handle_key", F.substring("handle", 2, 2**31 - 1))


def handle_keys(lines: DataFrame) -> DataFrame:
    """The distinct keys that mentions are compared with."""
    return handles(lines).select("handle_key").distinct()


def display_table(lines: DataFrame) -> DataFrame:
    """(handle, name) as written, for display."""
    stripped = lines.withColumn("value", F.regexp_replace("value", r"\s+$", ""))
    return _fields(stripped).select("handle", "name")


def terms(handle_table: DataFrame, max_terms: int = 400) -> list[str]:
    """The lower-cased handles as track terms for a source, which takes a few. Longer lists are
    for ``tracked_by_mention``, which takes the table itself."""
    found = [row[0] for row in handle_table.select("handle").distinct().limit(max_terms + 1).collect()]
    if len(found) > max_terms:
        raise ValueError("too many terms to track by text; match the mentions with the dictionary")
    return sorted(found)
