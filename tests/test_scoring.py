import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
import random
import re

from mentionflow.functions import labels, scoring
from mentionflow.operators import sentiment
from mentionflow.sources.labelled import labelled_jdbc

WEIGHTS = {"good": 1, "great": 2, "bad": -1, "awful": -2}


def brute_classes(text):
    cleaned = re.sub("[️\U0001f000-\U0001f7ff]", " ", text)
    found = []
    for s in re.split("[.!?]+", cleaned):
        if re.search(r"\S", s):
            words = re.findall("[a-z']+", s.lower())
            found.append(max(0, min(4, 2 + sum(WEIGHTS.get(w, 0) for w in words))))
    return found


def random_texts(n):
    rng = random.Random(5)
    vocabulary = [*WEIGHTS, "plain", "it's", "Good", "BAD", ".", "!", "?", "\U0001f600", "12"]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(n)]


def test_classes_equal_brute_force(values, X):
    texts = random_texts(200)
    assert values("string", texts, scoring.sentence_classes(X, WEIGHTS)) == [brute_classes(t) for t in texts]


def test_classes_with_a_large_lexicon(values, X):
    big = {f"w{chr(97 + i % 26)}{'x' * (i // 26)}": i % 5 - 2 for i in range(400)} | WEIGHTS
    rows = ["good waxx. bad", "great great great", "awful awful"]
    assert values("string", rows, scoring.sentence_classes(X, big))[1:] == [[4], [0]]


def test_empty_lexicon_is_neutral(values, X):
    assert values("string", ["good. bad"], scoring.sentence_classes(X, {})) == [[2, 2]]


def test_mean_of_empty_text_is_zero_and_of_no_sentence_is_null(values, X):
    rows = ["", "...", "good. great", None]
    assert values("string", rows, scoring.lexicon_scorer(WEIGHTS)(X)) == [0.0, None, 3.5, None]


def test_most_extreme_takes_the_first_of_a_tie(values, X):
    rows = [[1, 3, 2], [3, 1], [2, 2], [2, 0, 4], []]
    assert values("array<int>", rows, scoring.most_extreme(X)) == [1, 3, 2, 0, None]


def test_lexicon_table_equals_column_scorer_broadcast_and_salted(spark):
    texts = random_texts(60) + ["", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lexicon = spark.createDataFrame(list(WEIGHTS.items()), "word string, weight int")
    scorer = scoring.lexicon_scorer(WEIGHTS)
    expected = {r.id: r.score for r in sentiment.score_text(df, scorer=scorer, name="score").collect()}
    for bounds in ({}, {"max_rows": 1}):
        found = sentiment.score_by_lexicon_table(df, lexicon, max_literals=0, **bounds).collect()
        assert found[0].asDict().keys() == {"id", "score"} and {r.id: r.score for r in found} == expected
    assert sentiment.lexicon_weights(lexicon) == WEIGHTS
    assert sentiment.lexicon_weights(lexicon, max_rows=2) is None


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 1}])
def test_lexicon_table_scores_repeated_rows_and_words_once(spark, bounds):
    rows = [(1, "good."), (1, "good."), (1, "bad bad. good"), (2, ""), (2, ""), (None, "good good"), (3, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    lexicon = spark.createDataFrame(list(WEIGHTS.items()) * 2, "word string, weight int")
    expected = sentiment.score_text(df, scorer=scoring.lexicon_scorer(WEIGHTS), name="score")
    found = sentiment.score_by_lexicon_table(df, lexicon, max_literals=0, **bounds)
    key = lambda df: sorted(((r.id, r.score) for r in df.collect()), key=str)
    assert key(found) == key(expected)


def test_ranges_of_a_database_table_need_bounds(spark):
    with pytest.raises(ValueError, match="bounds"):
        labelled_jdbc(spark, "jdbc:none:", split_on="id")


def test_a_small_lexicon_is_scored_within_the_row(spark):
    texts = spark.createDataFrame([(1, "Good. bad bad!"), (2, None), (3, ""), (4, "..."), (5, "good good good")], "id long, text string")
    words = spark.createDataFrame([("good", 1), ("bad", -1), ("bad", -2)], "word string, weight int")
    within, joined = (sentiment.score_by_lexicon_table(texts, words, max_literals=n) for n in (2000, 0))
    assert sorted(map(tuple, within.collect())) == sorted(map(tuple, joined.collect()))
    assert "Exchange" not in within._jdf.queryExecution().executedPlan().toString()


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(batch):
            assert (batch.str.len() > 0).all()
            return batch.str.len().astype("float64")

        return model

    scorer = scoring.model_scorer(load)
    df = spark.range(200).selectExpr("if(id % 3 = 0, '', 'text') AS text").repartition(40)
    for _ in range(2):
        found = sentiment.score_text(df, scorer=scorer).groupBy("text").agg(F.avg("polarity")).collect()
        assert {tuple(r) for r in found} == {("", 0.0), ("text", 4.0)}
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert loads and len(loads) == len(set(loads))


def test_model_scorer_gets_clean_batches(spark):
    def load():
        return lambda batch: batch.str.len().astype("float64")

    df = spark.createDataFrame([("ab\U0001f600",), ("",), ("abcd",)], "text string").coalesce(1)
    found = sentiment.score_text(df, scorer=scoring.model_scorer(load)).collect()
    assert [r.polarity for r in found] == [3.0, 0.0, 4.0]


SCORES = [0.0, 1.99, 2.0, 2.049, 2.05, 4.0, math.nan, None]


def test_buckets(values, X):
    assert values("double", SCORES, labels.bucket(X)) == ["-", "-", "=", "=", "+", "+", "+", None]
    words = ["negative", "negative", "neutral", "neutral", "positive", "positive", "positive", None]
    assert values("double", SCORES, labels.bucket(X, labels.WORDS)) == words
    assert values("double", [None], labels.bucket(X, strict_reference=True)) == ["+"]


def test_binary_predictions_leave_nan_out(values, X):
    assert values("double", SCORES, labels.predicted_positive(X)) == [
        False, False, False, True, True, True, False, None
    ]
    assert values("double", SCORES, labels.predicted_negative(X)) == [
        True, True, True, False, False, False, False, None
    ]


def test_label_symbols(values, X):
    rows = ["positive", "POS", "Negative", "neutral", "", "apositive"]
    assert values("string", rows, labels.to_symbol(X)) == ["+", "+", "-", "=", "=", "="]


def test_scorer_sees_texts_of_a_batch_together(values, X, monkeypatch):
    monkeypatch.setattr(scoring, "SLICE_BYTES", 16)
    parts = ["good", "bad", "goods", "'bad", "GOOD", "é", ".", "!?", " ", "\n", "\U0001f389", "️", "\U0001f800", "x"]
    chosen = random.Random(3)
    texts = ["".join(chosen.choices(parts, k=chosen.randint(0, 9))) for _ in range(500)] + [None, "", " "]
    wanted = values("string", texts, scoring.mean_class(X, scoring.sentence_classes(X, WEIGHTS)))
    scorer = scoring.lexicon_scorer(WEIGHTS)
    assert values("string", texts, scorer(X)) == wanted
    lowered = pa.array([None if t is None else t.lower() for t in texts]).slice(3)
    means = scoring._Lexicon(WEIGHTS).means(lowered).to_pylist()
    assert [0.0 if t == "" else m for t, m in zip(texts[3:], means, strict=True)] == wanted[3:]
