"""Writers. Batch writers of a stream are keyed by batch, so a repeated batch replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionflow.functions.labels import to_symbol
from mentionflow.operators.messages import to_topic


# A message may hold megabytes, and readers take batches of thousands of rows, from one row group each. What a writer holds
# of a row group counts as compressed but for its last page, so with pages that are never full a group is that much of
# messages, not of what is left of them, and wide enough for texts that neighbouring windows share.
LARGE_ROWS = {
    "parquet.block.size": 16 << 20,
    "parquet.page.size": 64 << 20,
    "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 16,
}


def write_messages(
    messages: DataFrame, fmt: str = "parquet", path: str | None = None, mode: str = "append", **options: str
) -> None:
    """Write a batch of keyed messages to a broker (``kafka``) or to a message table at ``path``.

    A broker only appends, so a repeated batch is sent again.
    """
    if fmt == "kafka":
        to_topic(messages).write.format("kafka").options(**options).save()
    else:
        # like a broker's offsets, these order the messages of a write and tell them apart
        numbered = messages if "offset" in messages.columns else messages.withColumn("offset", F.monotonically_increasing_id())
        # windows overlap, so their messages repeat texts, which only a codec with a wide view makes small
        compact = {"compression": "zstd", **LARGE_ROWS} if fmt == "parquet" else {}
        numbered.write.format(fmt).mode(mode).options(**{**compact, **options}).save(path)


def write_text(lines: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    lines.select("value").write.mode(mode).options(**options).text(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def analyzed_path(path: str) -> str:
    """``base.ext`` becomes ``base-analyzed.ext``."""
    folder, _, name = path.rpartition("/")
    base, dot, ext = name.rpartition(".")
    renamed = f"{base}-analyzed.{ext}" if dot else f"{name}-analyzed"
    return f"{folder}/{renamed}" if folder else renamed


def batch_path(path: str, batch_id: int) -> str:
    """Where one micro-batch of a stream goes; reading ``path`` adds ``batch_id``."""
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def written_batches(spark: SparkSession, path: str) -> list[int]:
    """Micro-batches below ``path`` that are written whole."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch_id=*/_SUCCESS")
    found = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(files)
    return [int(f.getPath().getParent().getName().split("=")[1]) for f in found or []]


def export_labelled(labelled: DataFrame, path: str, label: str, text: str, mode: str = "errorifexists") -> None:
    """Label symbol and text as JSON lines."""
    rows = labelled.select(to_symbol(F.col(label)).alias("polarity"), F.col(text).alias("text"))
    write_json_lines(rows, path, mode)
