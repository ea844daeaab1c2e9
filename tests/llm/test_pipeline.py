import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from mentionflow.llm import mixing, quality_rules, secret_scan
from mentionflow.llm.queries import QUERIES, tokenizer_path
from tests.llm import brute
from tests.llm.test_mixing import check
from tests.llm.test_secret_scan import base


def test_stages_equal_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.01"  # the smaller table holds no secret
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    def apply(name, docs):
        stage[name](spark, docs, d).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    first = apply("quality_rules", docs)
    kept = {r.doc_id: r.text for r in first.collect()}
    verdict = {r.doc_id: r.quality for r in quality_rules.quality_scored(docs).collect()}
    assert set(kept) == {i for i, q in verdict.items() if q.kept} and first.columns == columns
    assert all(not brute.quality(t)[5] for t in kept.values())

    second = apply("ngram_jaccard", first)
    sets = {i: brute.shingles(t) for i, t in kept.items()}
    component = brute.components(sets, brute.jaccard_pairs(sets))
    assert sorted(r.doc_id for r in second.collect()) == sorted({*component.values()}) and second.columns == columns

    third = apply("secret_scan", second)
    rows = third.collect()
    assert third.columns == columns and sorted(r.doc_id for r in rows) == sorted({*component.values()})
    assert any(base(kept[r.doc_id]) for r in rows)
    for r in rows:
        assert r.text == secret_scan.redact(kept[r.doc_id]) and r.n_chars == len(r.text) and not base(r.text)

    fourth = apply("mixing", third)
    check(mixing.accounted(third).collect(), [r.asDict() for r in rows])
    copies = {r.doc_id: r.copies for r in mixing.accounted(third).collect()}
    assert {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    assert fourth.columns == columns

    last = apply("bpe", fourth)
    texts = {r.doc_id: r.text for r in rows}
    library = Tokenizer.from_file(tokenizer_path())
    for r in last.collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert last.count() == sum(copies.values())
    assert corpus_pipeline.run(spark, d).select("doc_id").count() == last.count()


def test_bpe_query_equals_the_library(spark):
    import hashlib

    d = "/root/testdata/sf0.01"
    library = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op7_bpe"](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
