"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

A time is the better of two runs, or of one if that takes long, from building the query to the
last row computed (results go to the noop sink). The session is warmed up by queries that are
not counted, one of them a windowed count.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from mentionflow.plans.queries import QUERIES

HEADLINE = [
    "sliding_count", "sliding_count_panes", "sliding_count_zero_fill", "topk_per_window",
    "extract_mentions", "text_score_mean", "text_score_lexicon_table", "scored_mention_rows",
    "sliding_collect_dedup", "collect_by_category", "sentiment_messages", "flatten_messages",
    "count_messages", "posneg_rollup", "f1_macro", "score_job", "tsv_predictions",
    "report_sentiment", "stream_panes", "stream_sentiment",
]
LONG_SECONDS = 12.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("mention_entities")
    run("sliding_count_daily")
    times = {}
    for name in HEADLINE:
        first = run(name)
        times[name] = round(first if first > LONG_SECONDS else min(first, run(name)), 3)

    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rates = {
        "sliding_count_posts_per_sec": round(events / times["sliding_count"]),
        "sliding_count_panes_posts_per_sec": round(events / times["sliding_count_panes"]),
        "text_score_texts_per_sec": round(documents / times["text_score_mean"]),
    }
    result = {
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
