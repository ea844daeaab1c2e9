import datetime as dt
import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from mentionflow.operators import windows
from mentionflow.operators.messages import flattened
from mentionflow.plans import queries
from mentionflow.session import GROUPS_AT_ONCE
from mentionflow.sinks import files
from mentionflow.streaming import jobs


def test_parts_have_the_files_that_a_trigger_takes(spark, tmp_path):
    path, rows = str(tmp_path / "posts"), spark.range(0, 40, 1, 4)
    queries.write_files(rows, path, 3)
    assert len(glob.glob(f"{path}/*.parquet")) == 3
    queries.write_files(rows.where("id < 5"), path, 3, 3)  # rows in one task only
    queries.write_files(rows.where("id < 0"), path, 3, 6)
    assert len(glob.glob(f"{path}/*.parquet")) == 9
    assert spark.read.parquet(path).count() == 45


def test_lagging_source_of_many_files(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "POSTS_PER_FILE", 100)
    wanted, write = [], queries.write_files

    def counted(rows, path, n, before=0):
        wanted.append(n)
        write(rows, path, n, before)

    monkeypatch.setattr(queries, "write_files", counted)
    found = queries.stream_lagging_source(spark, sf_dir).select("key", "window_start", F.get_json_object("value", "$.count").cast("long"))
    counts = windows.sliding_count(queries.mentions(spark, sf_dir), queries.DAY, queries.QUARTER)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, queries.plain(counts).select("mention", "window_start", "count").collect()))
    assert len(wanted) == 5 and min(wanted) > 1


def test_messages_are_packed(spark, tmp_path):
    path = str(tmp_path / "messages")
    files.write_messages(spark.range(3).select(F.lit("m").alias("value")), path=path)
    assert glob.glob(f"{path}/*.zstd.parquet")


def test_text_can_be_packed(spark, tmp_path):
    path = str(tmp_path / "report")
    files.write_text(spark.range(3).select(F.col("id").cast("string").alias("value")), path, compression="gzip")
    assert glob.glob(f"{path}/*.gz") and sorted(r.value for r in spark.read.text(path).collect()) == ["0", "1", "2"]


def test_row_groups_of_messages_are_bounded_by_what_they_expand_to(spark, tmp_path):
    """Readers take thousands of rows at once from a row group; before, one held messages until they filled it compressed."""
    text = F.repeat(F.concat(F.lit("a text that many windows share "), (F.col("id") % 7).cast("string")), 30_000)
    rows = spark.range(0, 64, 1, 1).select(
        F.lit("t").alias("topic"), F.lit("k").alias("key"), text.alias("value"), F.current_timestamp().alias("window_start"),
        F.current_timestamp().alias("window_end"), F.lit(0).alias("part"), F.lit(1).alias("parts"),
    )
    files.write_messages(rows, path=str(tmp_path / "m"))
    (path,) = (tmp_path / "m").glob("part-*")
    found = pq.ParquetFile(path).metadata
    sizes = [found.row_group(n).total_byte_size for n in range(found.num_row_groups)]
    assert sum(sizes) > 50 << 20 and max(sizes) < 36 << 20
    assert path.stat().st_size < 2 << 20 and spark.read.parquet(str(tmp_path / "m")).where(F.length("value") > 900_000).count() == 64


def test_a_stream_collects_few_large_arrays_at_once(spark, monkeypatch, tmp_path):
    start, end = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 5)
    schema = "mention string, id long, created_at timestamp, text string, cat string, polarity double, day date"
    rows = spark.createDataFrame([(f"m{i % 20}", i, start, "x", "=", 2.0, start.date()) for i in range(100)], schema)
    rows.write.partitionBy("day").parquet(str(tmp_path / "table"))
    counts = spark.createDataFrame([(start, end)], "window_start timestamp, window_end timestamp")
    seen, before = [], spark.conf.get(GROUPS_AT_ONCE)

    def write(*args, **options):
        seen.append(spark.conf.get(GROUPS_AT_ONCE))
        files.write_messages(*args, **options)

    monkeypatch.setattr(jobs, "write_messages", write)
    jobs.sentiment_output(str(tmp_path / "table"), str(tmp_path / "out"), "5 minutes", "5 minutes")(counts, 0)
    assert int(seen[0]) < 16 and spark.conf.get(GROUPS_AT_ONCE) == before
    assert flattened(spark.read.parquet(str(tmp_path / "out"))).count() == 100
