import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from mentionflow.llm import language_id as g
from mentionflow.llm.queries import QUERIES


def kneser_ney(counts):
    """{order: probability function} of one language, by the textbook, from n-gram counts."""
    tables = {g.ORDER: counts}
    for order in range(g.ORDER - 1, 0, -1):
        tables[order] = {}
        for gram in tables[order + 1]:
            tables[order][gram[1:]] = tables[order].get(gram[1:], 0) + 1
    return tables


def probability(tables, gram, vocabulary):
    order = len(gram)
    if order == 0:
        return 1 / (vocabulary + 1)
    table = tables[order]
    n1, n2 = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
    discount = n1 / (n1 + 2 * n2) if n1 * n2 else 0.75
    same = {k: c for k, c in table.items() if k[:-1] == gram[:-1]}
    lower = probability(tables, gram[1:], vocabulary)
    if not same:
        return lower
    total = sum(same.values())
    return max(table.get(gram, 0) - discount, 0) / total + discount * len(same) / total * lower


def scorer(spark, counts):
    rows = [(lang, gram, n) for lang, table in counts.items() for gram, n in table.items()]
    model = g._written(g._terms(spark.createDataFrame(rows, "lang string, gram string, n long")), sorted(counts))
    return model, g.Scorer([SparkFiles.get(f) for f in model.files], model.bits, len(counts))


def counted(texts):
    counts = {}
    for lang, text in texts.items():
        padded = "   " + text + " "
        counts[lang] = dict(Counter(padded[i : i + 4] for i in range(len(padded) - 3)))
    return counts


@pytest.mark.parametrize("segment", [1 << 20, 4])
def test_model_equals_the_textbook(spark, monkeypatch, segment):
    monkeypatch.setattr(g, "SEGMENT_ROWS", segment)
    counts = counted({"xx": "aba abba baab abc", "yy": "zaz bab zzb aa"})
    model, scored = scorer(spark, counts)
    assert (model.bits > 3) == (segment == 4) and len(scored.segments) > (3 if segment == 4 else 0)
    letters = {c for table in counts.values() for gram in table for c in gram[-1:]}
    found = scored.entropies(["aba zq", "q", "abba"])
    for row, text in zip(found, ["aba zq", "q", "abba"], strict=True):
        padded = "   " + text + " "
        for j, lang in enumerate(model.languages):
            tables = kneser_ney(counts[lang])
            logs = [np.log(probability(tables, padded[i : i + 4], len(letters))) for i in range(len(padded) - 3)]
            assert row[j] == pytest.approx(-np.mean(logs), abs=1e-8)


def test_held_rows_and_pieces_do_not_matter(spark, monkeypatch):
    _, scored = scorer(spark, counted({"xx": "aba abba baab abc ж𝐀", "yy": "zaz bab zzb aa", "zz": "a"}))
    texts = ["abba zq ж𝐀ж", "q", "ba" * 5_000, "zaz"] * 3
    want = scored.entropies(texts)
    monkeypatch.setattr(g, "HELD", 12)
    monkeypatch.setattr(g, "RUN", 30)
    scored._hold(np.zeros(0, np.uint64), np.zeros((0, 3)))
    assert np.allclose(scored.entropies(texts), want, atol=2e-9, rtol=0)
    assert np.allclose(np.concatenate([scored.entropies([t]) for t in texts]), want, atol=2e-9, rtol=0)


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, d).collect()
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.held_out and len(docs[r.doc_id].text) > 40:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert right >= 0.97 * total and total > 100


def test_odd_rows(spark):
    texts = {"aa": "the house of the tree and the river", "bb": "la maison de la rivière est très belle"}
    rows = [(i, t, lang, "z") for i in range(60) for lang, t in texts.items()]
    rows += [(1000, None, "aa", "z"), (1001, "", "aa", "z"), (1002, "12 + 3", "bb", "z"), (None, "the tree", None, "z"), (1003, "the river " * 50_000, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, letters string")
    got = g.identified(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 1000}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert [by[i].score for i in (1000, 1001, 1002)] == [0, 0, 0] and by[1003].score > 0.9
    assert [r.lang_pred for r in got if r.doc_id is None] == ["aa"]
    assert {r.lang_pred for r in g.identified(df.withColumn("lang", df.lang.substr(9, 1)).filter("lang is null")).collect()} <= {"und", ""}
    assert g.identified(df.limit(0)).count() == 0


def test_a_model_of_many_segments_is_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = [(None, "the tree", None), (-1, None, "en"), (-2, "12 + 3", "fr"), (-3, "ßß 𝐀𝐁 жж", None), (-3, "a", "de")]
    df = df.union(spark.createDataFrame(more, df.schema))
    rows = lambda: sorted(g.identified(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.entropy or 0))
    want = rows()
    monkeypatch.setattr(g, "SEGMENT_ROWS", 500)
    got = rows()
    assert len(got) == len(want) == df.count()
    assert got == want  # a null entropy is None


def test_a_model_of_over_a_million_weights(spark):
    alphabet = [chr(0x4E00 + i) for i in range(90)]
    grams = spark.range(90**3).select(
        F.concat(*[F.get(F.array(*map(F.lit, alphabet)), ((F.col("id") / 90**i) % 90).cast("int")) for i in range(3)]).alias("tail"), "id"
    )
    counts = grams.select(F.when(F.col("id") % 2 == 0, "xx").otherwise("yy").alias("lang"), F.concat(F.lit(alphabet[0]), "tail").alias("gram"), (F.col("id") % 5 + 1).alias("n"))
    model = g._written(g._terms(counts), ["xx", "yy"])
    scored = g.Scorer([SparkFiles.get(f) for f in model.files], model.bits, 2)
    assert model.bits >= 1 and len(scored.segments) == 1 << model.bits
    assert all((np.diff(s[0].astype(object)) > 0).all() for s in list(scored.segments.values())[:1])
    codes = np.array([0x4E00, 0x4E00 + 7, 0x4E00 + 8, 0x4E00 + 9], np.uint32)
    row = scored.computed(codes, np.array([0]))[0]
    assert np.isfinite(row).all() and row[0] != row[1]
