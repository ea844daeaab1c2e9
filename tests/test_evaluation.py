import statistics

import pytest

from mentionflow.operators import dashboard, evaluation

ROWS = [("+", 3.0), ("+", 2.0), ("+", 2.5), ("-", 1.0), ("-", 2.5), ("=", 2.0), ("=", None), ("-", float("nan"))]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(ROWS, "polarity string, sentiment double")


def test_spread_uses_the_sample_deviation(scored):
    found = {r.polarity: (r.low, r.mean, r.high) for r in evaluation.label_spread(scored).collect()}
    m, s = statistics.mean([3.0, 2.0, 2.5]), statistics.stdev([3.0, 2.0, 2.5])
    assert found["+"] == pytest.approx((m - s, m, m + s))
    assert found["-"][1] == 1.75
    assert found["="] == (None, 2.0, None)


def test_precision_recall_and_f1(scored):
    r = evaluation.precision_recall(scored).first()
    assert (r.pos_true, r.pos_predicted, r.pos_correct) == (3, 3, 2)
    assert (r.neg_true, r.neg_predicted, r.neg_correct) == (3, 3, 1)
    f = evaluation.f1_macro(scored).first()
    assert f.f1_pos == pytest.approx(2 / 3) and f.f1_neg == pytest.approx(1 / 3)
    assert f.score == pytest.approx(50.0)


def test_no_prediction_gives_null_not_an_error(scored):
    r = evaluation.f1_macro(scored, cutoff=9.0).first()
    assert r.f1_pos is None and r.score is None and r.f1_neg is not None


def test_scores_of_a_label_and_row_count(scored):
    assert sorted(r[0] for r in evaluation.scores_of(scored, "+").collect()) == [2.0, 2.5, 3.0]
    assert evaluation.row_count(scored).first()["rows"] == len(ROWS)


def test_one_shuffle_for_all_counters(scored):
    plan = evaluation.f1_macro(scored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_counts_per_handle_fills_zero(spark):
    handles = spark.createDataFrame([("@a", "a"), ("@b", "b")], "handle string, handle_key string")
    counts = spark.createDataFrame([("A", 2), ("a", 1), ("x", 9)], "mention string, count long")
    assert {tuple(r) for r in dashboard.counts_per_handle(handles, counts).collect()} == {("@a", 3), ("@b", 0)}


def test_positive_negative_totals(spark):
    rows = [("a", "+", 1), ("a", "-", 2), ("a", "=", 3), ("b", "+", 4), (None, "+", 5)]
    df = spark.createDataFrame(rows, "mention string, cat string, t int").selectExpr(
        "mention", "cat", "timestamp_seconds(t) AS created_at"
    )
    found = {tuple(r) for r in dashboard.positive_negative(df).collect()}
    assert found == {("a", 1, 1, False), ("b", 1, 0, False), (None, 1, 0, False), ("Total", 3, 1, True)}
    from pyspark.sql import functions as F

    part = dashboard.positive_negative(df, F.timestamp_seconds(F.lit(2)), F.timestamp_seconds(F.lit(5)))
    assert ("Total", 1, 1, True) in {tuple(r) for r in part.collect()}
