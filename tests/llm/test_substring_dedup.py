import hashlib
import random

import pyarrow as pa
import pytest

from mentionflow.llm import substring_dedup
from mentionflow.llm.queries import QUERIES
from mentionflow.llm.wordhash import words_of
from tests.llm import brute


def test_documents_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = dict(zip([i for i, _ in docs], brute.substring_kept(docs), strict=True))
    rows = QUERIES["op9_substring_dedup"](spark, d).collect()
    assert len(rows) == len(docs) and sum(r.n_removed for r in rows) > 1000
    for r in rows:
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, n - len(kept)), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_odd_rows(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, "a b"), (None, passage), (None, passage + " é"), (5, f"x {passage}\n\x0by"), (5, f"x {passage}\n\x0by"), (4, passage)]
    rows += [(7, None), (8, ""), (9, "w " * 3000), (10, (passage + " ") * 4), (-3, f"{passage} z"), (6, passage.upper())]
    rows += [(20 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(15, 90)))) for i in range(60)]
    df = spark.createDataFrame([(d, t, i, "n") for i, (d, t) in enumerate(rows)], "doc_id long, text string, dedup long, d string")
    df = df.withColumnRenamed("dedup", "at").repartition(5)
    got = substring_dedup.deduplicated(df)
    assert got.columns == ["doc_id", "text", "at", "d", "dedup"]
    got = {r["at"]: r for r in got.collect()}
    assert len(got) == len(rows)
    for i, (n, kept) in enumerate(brute.substring_kept(rows)):
        assert (got[i].dedup.n_words, got[i].dedup.kept) == (n, " ".join(kept)), rows[i]
        assert got[i].text == rows[i][1]
    assert substring_dedup.deduplicated(df.limit(0)).count() == 0


def alternating(letters, bits):
    """The word of 2^bits letters that a number of ones, even or odd, gives at each place."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(1 << bits))


@pytest.mark.parametrize("bits", [9, 12])
def test_words_that_alternate_have_hashes_of_their_own(spark, bits):
    one, other = alternating("ab", bits), alternating("ba", bits)
    words = words_of(pa.array([f"{one} {other} {one}"]))
    for key in (0, 1):
        first, second, third = words.hashes(key)
        assert first == third != second
    text = " ".join([one] + ["w"] * 25)
    rows = [(1, text), (2, text.replace(one, other)), (3, " ".join(["v"] * 3 + [one, *"abcdefghijklmnopqrs"])), (4, " ".join([other, *"abcdefghijklmnopqrs"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.dedup.n_words, r.dedup.kept.split(" ") if r.dedup.kept else []) for r in substring_dedup.deduplicated(df).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute.substring_kept(rows), strict=True)}
