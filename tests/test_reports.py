import datetime as dt
import random

from pyspark.sql import functions as F

from mentionflow.session import checkpointed
from mentionflow.sinks import files, ordered, reports
from mentionflow.streaming import jobs

START, END = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 5)
RULE = "_" * 72


def test_top_k_layout(spark):
    counts = spark.createDataFrame(
        [(START, END, m, c) for m, c in [("Qantas", 7), ("AmericanAir", 11), ("KLM", 7), ("x", 1)]],
        "window_start timestamp, window_end timestamp, mention string, count long",
    )
    text = reports.top_k_report(counts, 3).first().value
    assert text == (
        f"{RULE}\nTop 3 handles in the last 300000 ms (non-cumulative):\n"
        "  11 -> @AmericanAir\n  7 -> @KLM\n  7 -> @Qantas"
    )


def sentiment_frame(spark):
    rows = [
        (1, START, "so good", "+", 3.0), (2, START, "fine", "=", 2.0), (3, START, "best", "+", 4.0),
        (4, START, "bad", "-", 1.25), (5, START, "...", None, None), (6, END, "later", "=", 2.0),
        (1, START, "so good", "+", 3.0),
    ]
    return spark.createDataFrame(rows, "id long, created_at timestamp, text string, cat string, polarity double")


def test_sentiment_report_in_reading_order(spark, tmp_path):
    lines = reports.in_report_order(reports.sentiment_report(sentiment_frame(spark), slide="5 minutes"))
    title = f"{RULE}\nTweets with sentiment in the last 300000 ms:"
    expected = [
        title, "  (+)", "    [4.0]: best", "    [3.0]: so good", "    [3.0]: so good", "  (=)", "    [2.0]: fine",
        "  (-)", "    [1.3]: bad", "  (null)", "    [null]: ...", title, "  (=)", "    [2.0]: later",
    ]
    assert [r.value for r in lines.collect()] == expected
    files.write_text(lines, str(tmp_path / "report"))
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "\n".join(expected) + "\n"


def test_report_of_some_windows_only(spark):
    ends = (END, END)
    lines = reports.sentiment_report(sentiment_frame(spark), slide="5 minutes", ends=ends)
    assert lines.where(F.contains("value", F.lit("later"))).count() == 0
    assert lines.where(F.contains("value", F.lit("best"))).count() == 1


def test_lines_are_packed_and_sorted_as_spark_sorts_them(spark, monkeypatch):
    """Texts are neither stored nor shuffled as they are, and partitions follow the bytes of text."""
    stored = []
    monkeypatch.setattr(reports, "checkpointed", lambda df: stored.append(df.columns) or checkpointed(df))
    monkeypatch.setattr(ordered, "PART_BYTES", 4_000)
    monkeypatch.setattr(ordered, "PACK_BYTES", 6_000)
    monkeypatch.setattr(ordered, "BLOCK_BYTES", 3_000)
    rng = random.Random(3)
    scores = [None, float("nan"), 0.0, -0.0, -1.5, 2.0, 2.25, 4.0, float("inf")]
    rows = [
        (rng.choice([None, -5, 0, n, 7, 2**62]), START + dt.timedelta(minutes=rng.randint(0, 30)), f"é{n}" * 20, rng.choice(["+", "=", "-", None]), rng.choice(scores))
        for n in range(900)
    ]
    df = spark.createDataFrame(rows * 2, "id long, created_at timestamp, text string, cat string, polarity double").repartition(5)
    lines = reports.sentiment_report(df, "10 minutes", "5 minutes")
    got = reports.in_report_order(lines)
    assert got.rdd.getNumPartitions() > 20
    section = F.when(F.col("cat") == "", 0).when(F.col("cat") == "+", 1).when(F.col("cat") == "=", 2).when(F.col("cat") == "-", 3).otherwise(4)
    order = ["window_start", section, "level", F.desc("polarity"), "id"]
    plain = [(r.value, (r.window_start, r.cat, r.level, str(0.0 if r.polarity == 0 else r.polarity), r.id)) for r in lines.orderBy(*order).collect()]
    values, at = [r.value for r in got.collect()], 0
    while at < len(plain):  # lines with equal keys come in any order
        end = at
        while end < len(plain) and plain[end][1] == plain[at][1]:
            end += 1
        assert sorted(values[at:end]) == sorted(v for v, _ in plain[at:end])
        at = end
    assert len(values) == len(plain) > 3600 and stored and not any("text" in columns for columns in stored)


def test_a_stream_reports_each_post_once_without_storing_the_others(spark, monkeypatch, tmp_path):
    rows = [("a", n, START, f"text {n}", "=", 2.0) for n in range(200)] + [("b", n, START, f"text {n}", "=", 2.0) for n in range(0, 200, 40)]
    rows += [("a", None, START, "text none", "+", 3.0), ("b", None, START, "text none", "+", 3.0), ("a", 1, END, "text 1 later", "-", 1.0)]
    scored = spark.createDataFrame(rows, "mention string, id long, created_at timestamp, text string, cat string, polarity double")
    stored = []
    monkeypatch.setattr(jobs, "checkpointed", lambda df: stored.append(checkpointed(df)) or stored[-1])
    got = [r.text for r in jobs._once(scored).collect()]
    assert sorted(got) == sorted([f"text {n}" for n in range(200)] + ["text none", "text 1 later"])
    assert 6 <= sum(df.count() for df in stored if "text" in df.columns) < 30
    table, out = str(tmp_path / "table"), str(tmp_path / "report")
    scored.withColumn("day", F.to_date("created_at")).write.partitionBy("day").parquet(table)
    counts = spark.createDataFrame([(START, END)], "window_start timestamp, window_end timestamp")
    jobs.sentiment_report_output(table, out, "5 minutes", "5 minutes")(counts, 0)
    lines = [r.value for r in spark.read.text(f"{out}/batch_id=0").collect()]
    assert sum("text" in line for line in lines) == 201 and lines[3].endswith("text none")
