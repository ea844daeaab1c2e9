"""Scans of labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionflow.schemas import LABELLED


def read_labelled(spark: SparkSession, path: str, schema: T.StructType = LABELLED) -> DataFrame:
    """JSON lines, split at the ASCII newline only; a line that does not parse fails the job."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n")
    return reader.json(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines, blank ones too, split at the ASCII newline only."""
    return spark.read.option("lineSep", "\n").text(path)


def _fields(lines: DataFrame) -> DataFrame:
    # Trailing empty fields do not count.
    return lines.withColumn("_f", F.split(F.regexp_replace("value", r"\t+$", ""), "\t"))


def tsv_fields(lines: DataFrame) -> DataFrame:
    """``value`` of each line, and uid, actual and text where it has exactly four fields."""
    four = F.when(F.size("_f") == 4, F.col("_f"))
    return _fields(lines).select("value", four[1].alias("uid"), four[2].alias("actual"), four[3].alias("text"))


def labelled_tsv(lines: DataFrame) -> DataFrame:
    """(uid, actual, text) of the lines with exactly four tab-separated fields."""
    good = _fields(lines).where(F.size("_f") == 4)
    return good.select(F.col("_f")[1].alias("uid"), F.col("_f")[2].alias("actual"), F.col("_f")[3].alias("text"))


def malformed_tsv(lines: DataFrame) -> DataFrame:
    """The other lines, whole."""
    return _fields(lines).where(F.size("_f") != 4).select(F.col("value").alias("line"))


def labelled_table(
    spark: SparkSession, table: str, label: str = "airline_sentiment", text: str = "text"
) -> DataFrame:
    """Label and text of a catalog table."""
    return spark.table(table).select(label, text)


def labelled_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "tweets",
    label: str = "airline_sentiment",
    text: str = "text",
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **properties: str,
) -> DataFrame:
    """Label and text of a database table; ``split_on`` reads ranges of a column in parallel, and
    needs the ``bounds`` of its values."""
    if split_on is not None and bounds is None:
        raise ValueError("split_on needs bounds: the smallest and the largest value of the column")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if split_on is not None:
        low, high = bounds
        reader = reader.options(
            partitionColumn=split_on, lowerBound=low, upperBound=high, numPartitions=partitions
        )
    return reader.load().select(label, text)
