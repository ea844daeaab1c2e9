import random

import numpy as np
import pytest

from mentionflow.llm import components, jaccard_join, partners, sketch
from mentionflow.llm.components import connected_components
from mentionflow.llm.queries import QUERIES
from mentionflow.session import checkpointed
from tests.llm import brute
from tests.llm.test_substring_dedup import alternating


def want_of(rows):
    sets = {d: brute.shingles(t) for d, t in rows}
    return sets, brute.components(sets, brute.jaccard_pairs(sets))


def test_documents_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    sets, want = want_of([(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])
    got = QUERIES["op2_ngram_jaccard"](spark, d).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(got) == len(sets) and len(set(want.values())) < len(sets)


def near_copies(seed):
    """Chains and groups of texts that differ by a few words, around the threshold."""
    rng, rows = random.Random(seed), []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(rng.choice([4, 5, 9, 30, 60, 150]))]
        if group % 2:
            base += [f"common{i}" for i in range(40)]
        for _ in range(15):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 50)}"
            rows.append((len(rows), " ".join(words)))
            if rng.random() < 0.3:
                base = words
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("matches", "pair_rows"), [(1, 10_000), (8, 0), (8, 20)])
def test_near_copies_around_the_threshold(spark, monkeypatch, matches, pair_rows):
    monkeypatch.setattr(jaccard_join, "FAMILY_BLOCK", 7)
    rows = near_copies(matches + pair_rows)
    sets, want = want_of(rows)
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n string")
    join = jaccard_join.Join(most_matches=matches, star_rounds=1, pair_rows=pair_rows)
    got = {r.doc_id: r.component_id for r in jaccard_join.grouped(df, join).collect()}
    assert got == want
    least = {}
    for i, s in sorted(sets.items()):
        least.setdefault(s, i)
    classes = {i: s for s, i in least.items()}
    assert {(r.a, r.b) for r in jaccard_join.linked_pairs(df, join).collect()} == brute.jaccard_pairs(classes)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, long), (8, long + " x"), (None, long), (None, None)]
    rows += [(9, "one two three four five six"), (9, "one two three four five six"), (9, "other words here now"), (10, "other words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.grouped(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].component_id for i in range(1, 9)] == [1, 2, 3, 4, 4, 6, 7, 7] and by[10].component_id == 9
    assert [by[i].n_shingles for i in (1, 4, 7)] == [0, 1, 29_996]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["7", "None"]
    kept = jaccard_join.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 9, 9, 9]
    assert jaccard_join.grouped(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(150)] + [(-5, 700), (9, 9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute.components({x for p in pairs for x in p}, pairs)
    used = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {n: c for n, c in want.items() if n in used}


def test_components_of_stars_and_chains(spark):
    """Nodes with most of all edges, at either end of the order, and tied rows."""
    least = [(0, n) for n in range(1, 1500)]
    largest = [(9999, n) for n in range(2000, 3500)]
    chain = [(n, n + 1) for n in range(4000, 4300)]
    pairs = least + largest + chain + [(1499, 2000), (7, 7), (4100, 4100), *least[:50]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == brute.components({x for p in pairs for x in p}, pairs)
    assert len(set(got.values())) == 2


def test_alternating_words_are_not_shared(spark):
    one, other = alternating("ab", 9), alternating("ba", 9)
    rows = [(1, f"{one} b c d e"), (2, f"{other} b c d e"), (3, f"{one} b c d e")]
    got = {r.doc_id: r.component_id for r in jaccard_join.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_an_id_with_several_texts_joins_their_groups(spark):
    texts = {x: " ".join(f"{x}{i}" for i in range(12)) for x in "abcd"}
    rows = [(3, texts["a"]), (5, texts["a"]), (5, texts["b"]), (7, texts["b"]), (8, texts["c"]), (8, None), (9, texts["d"]), (8, texts["d"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.grouped(df).filter("n_shingles > 0").collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 8)}


@pytest.mark.parametrize("most_words", [1, 1 << 18])
def test_rows_that_stay_are_not_shuffled_with_their_texts(spark, monkeypatch, most_words):
    """Texts are shuffled only where a row's id may be one that goes."""
    monkeypatch.setattr(jaccard_join, "MOST_WORDS", most_words)
    monkeypatch.setattr(jaccard_join, "IDS_PER_WORD", 1)
    texts = [" ".join(f"t{i % 3 if i % 2 else i}w{j}" for j in range(9)) for i in range(4000)]
    rows = [*enumerate(texts), (None, texts[0]), (None, None), (1, None), (7, None), (7, texts[7])]
    df = spark.createDataFrame(rows, "`doc.id` long, text string").repartition(3)
    got = jaccard_join.representatives(df, doc_id="doc.id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "rightHint=(strategy=broadcast)" in plan
    sets, want = want_of([(i, t) for i, t in enumerate(texts)])
    stay = sorted((i, t) for i, t in rows if i is not None and t is not None and (want[i] == i or i == 7))
    found = [tuple(r) for r in got.collect()]
    assert got.columns == df.columns
    assert sorted(r for r in found if r[0] is not None and r[1] is not None) == stay
    assert sum(r[0] is None for r in found) == 2 and (7, None) in found and len(set(want.values())) < len(texts)


def test_components_store_what_they_read_again_in_few_tasks(spark, monkeypatch):
    """Plans and tasks of a round are held by the driver: stars that are settled take no round, others few tasks."""
    stored = []
    monkeypatch.setattr(components, "checkpointed", lambda df: stored.append(df) or checkpointed(df))
    settled = [(n % 7, n) for n in range(7, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(settled, "a long, b long")).collect()}
    assert got == {n: n % 7 for n in range(300)} and len(stored) == 1
    stored.clear()
    moving = [(n, n + 1) for n in range(20)] + [(n % 7 + 100, n + 100) for n in range(7, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(moving, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **{n + 100: n % 7 + 100 for n in range(300)}}
    assert len(stored) > 2 and all(df.rdd.getNumPartitions() == 1 for df in stored[1:])


def test_what_a_join_stores_has_no_more_parts_than_its_rows_need(spark, monkeypatch):
    """Each part is a file, for which a task may start a process: they don't grow with the partitions of a shuffle."""
    parts = []

    def stored(df):
        out = checkpointed(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    settings = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for module in (components, jaccard_join):
        monkeypatch.setattr(module, "checkpointed", stored)
    rows = near_copies(4)
    want = want_of(rows)[1]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = sorted(r.doc_id for r in jaccard_join.representatives(df).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted({c for c in want.values()})
    # candidate pairs and links of families keep theirs, as their work grows faster than their rows
    assert len(parts) > 9 and sum(n > 2 for n in parts) <= 2, parts


def filled(df, hashes_of, shape, *least, real=sketch.repeated_bits):
    """The bits of a sketch that holds far more shingles than bits: every one may repeat."""
    return real(df, hashes_of, shape, *least) if least else np.full(sketch.ROWS * shape.segments * sketch.SEGMENT_BITS // 8, 255, np.uint8)


def test_a_full_sketch_does_not_store_documents_without_a_partner(spark, monkeypatch):
    """Before, all shingles of all documents were stored and indexed once the sketch was full."""
    monkeypatch.setattr(sketch, "repeated_bits", filled)
    rows = near_copies(11)
    alone = [(1000 + i, " ".join(f"a{i}w{j}" for j in range(40)) + " common0 common1 common2 common3 common4 common5 common6") for i in range(300)]
    copies = [(2000 + i, text) for i, (_, text) in enumerate(alone[:100])]
    df = spark.createDataFrame(rows + alone + copies, "doc_id long, text string").repartition(3)
    p = jaccard_join._prepared(df, jaccard_join.Join(), "doc_id", "text")
    assert p.n_suspects <= len(rows)
    want = want_of(rows + alone + copies)[1]
    assert {r.doc_id: r.component_id for r in jaccard_join.grouped(df).collect()} == want


@pytest.mark.parametrize(("pending", "docs", "marks"), [(50, 60_000, 30), (2 << 20, 3, 2 << 20)])
def test_partners_are_found_across_lists_and_buckets(spark, monkeypatch, pending, docs, marks):
    for name, value in (("PENDING", pending), ("MOST_DOCS", docs), ("BUCKET_MARKS", marks)):
        monkeypatch.setattr(partners, name, value)
    rows = near_copies(21) + [(500 + i, text) for i, text in enumerate(["", None, "one", "One", "a b c d e f", "a b c d e f g"])]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(4)
    sets, want = want_of([(i, t or "") for i, t in rows])
    got = jaccard_join.grouped(df).collect()
    assert len(got) == len(rows) + 5 and {r.doc_id: r.component_id for r in got} == want
