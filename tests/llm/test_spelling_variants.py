import random

import numpy as np
import pytest

from mentionflow.llm import spelling_variants
from mentionflow.llm.queries import QUERIES
from mentionflow.llm.tables import table
from tests.llm import brute


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def alike_words(seed, n, letters="abé", least=7, most=11):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(letters, k=rng.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("key_words, block_rows", [(8192, 16_384), (30, 60), (2, 9)])
def test_near_words_equal_brute_force(spark, key_words, block_rows):
    words = alike_words(1, 700) + ["letters", "letterss", "lletters", "letterz", "zetters", "xlettersx"]
    counts = {w: 1 + i % 13 for i, w in enumerate(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling_variants.near_words(df, key_words, block_rows).collect()}
    expected = {}
    for word, near in brute.near_words(counts).items():
        if near:
            best = min(near, key=lambda x: (-counts[x], x))
            expected[word] = len(near), counts[best], best
    assert got == expected


def test_recurrences_over_more_than_one_machine_word():
    words = alike_words(2, 1500, "abc", 8, 8)
    letters = spelling_variants._matrix(words, 8)
    query, word = spelling_variants.replaced(spelling_variants.PositionIndex(letters), letters, 0, 8)
    near = brute.near_words(words)
    assert {(words[q], words[w]) for q, w in zip(query, word, strict=True)} == {(a, b) for a in near for b in near[a]}
    assert len(words) > 256 and query.dtype == np.int64


def test_short_and_long_words(spark):
    words = {"a": 1, "b": 2, "ab": 3, "ba": 4, "x" * 3000: 5, "x" * 3001: 6, "x" * 2000 + "y" + "x" * 999: 7, "x" * 2999 + "y": 8}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: r.n_near for r in spelling_variants.near_words(df).collect()}
    assert got == {w: len(near) for w, near in brute.near_words(words).items() if near}


def test_forms_and_roots(spark):
    rows = [(i, "lettering " * 2000) for i in (1, 2)] + [(3, "letterin " * 150 + "Letteri " * 12 + "letter letters LETTERS ")]
    rows += [(4, "Été-ÉTÉSÉTÉS étésétés ×÷×÷×÷× ×÷×÷×÷×"), (5, None), (6, ""), (None, "nothing nothing nothińg"), (5, "letters")]
    rows += [(7, "nothing" * 4000), (7, "nothing" * 4000), (8, "many_words_apart 1apartments2 apartments")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n long")
    got = rows_of(spelling_variants.grouped(df))
    assert got == brute.variants(rows)
    assert got["letteri"][:2] == ("letterin", "lettering")


def test_empty_table(spark):
    assert spelling_variants.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op13_spelling_variants"](spark, sf_dir))
    assert got == brute.variants(rows) and any(form for form, *_ in got.values())
