"""Every query against its SQL twin, and the contract of the entry module."""


import pytest

import tests.conftest  # noqa: F401  (puts the repository on the path)
from __spark_entry__ import entry, oracle_sql, queries
from mentionflow.session import scratch_path, shared_dir
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def con():
    return connect(tests.conftest.SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert difference(queries()[name](spark, sf_dir), con, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry_gives_top_handles(spark):
    df = entry(spark)
    assert df.columns == ["window_start", "window_end", "mention", "count", "rank"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_scratch_paths_are_new_and_below_the_shared_folder(spark):
    one, two = scratch_path(spark, "a"), scratch_path(spark, "a")
    assert one != two and one.startswith(shared_dir(spark))
    assert spark.conf.get("spark.checkpoint.dir") == shared_dir(spark)



PLANS = [
    "sliding_count_panes", "topk_per_window", "scored_mention_rows", "sentiment_messages", "posneg_rollup",
    "zero_filled_dictionary", "precision_recall",
]


@pytest.mark.parametrize("name", PLANS)
def test_plans_have_no_nested_loops(spark, sf_dir, name):
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_counting_does_not_read_the_text(spark, sf_dir):
    plan = queries()["sliding_count_panes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and not any("text:string" in scan or "text#" in scan for scan in scans)
    assert any("EqualTo(lang,en)" in scan for scan in scans)
