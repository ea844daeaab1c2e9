"""Runs queries and their SQL twins over the same tables and compares the results.

As a script: ``python tests/compare.py SF_DIR [query …]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, list):
        return tuple(value)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_bag(df):
    return sorted(df.columns), _bag(df.columns, [tuple(r) for r in df.collect()])


def sql_bag(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), _bag(columns, result.fetchall())


def difference(df, con, sql) -> str | None:
    """None if both give the same columns and rows, else a short description."""
    ours, theirs = spark_bag(df), sql_bag(con, sql)
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] == theirs[1]:
        return None
    more, less = ours[1] - theirs[1], theirs[1] - ours[1]
    return (
        f"rows {sum(ours[1].values())} vs {sum(theirs[1].values())}; only in Spark "
        f"{str(more.most_common(2))[:400]}; only in SQL {str(less.most_common(2))[:400]}"
    )


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, all_queries, sqls = connect(sf_dir), queries(), oracle_sql()
    failed = []
    for name in names or all_queries:
        start = time.time()
        try:
            df = all_queries[name](spark, sf_dir)
            if name in sqls:
                result = difference(df, con, sqls[name])
            else:
                df.collect()
                result = None
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:600]}"
        failed += [name] if result else []
        kind = "" if name in sqls else " (no SQL)"
        print(f"{time.time() - start:6.1f}s {name}{kind}: {result or 'ok'}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
