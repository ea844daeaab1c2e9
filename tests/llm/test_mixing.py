import re

import pytest

from mentionflow.llm import mixing
from mentionflow.llm.queries import QUERIES


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes, weights, budget, cap):
    """Targets by repeated sharing of what lies above the caps."""
    got = [0.0] * len(sizes)
    left, open_ = budget, [i for i in range(len(sizes)) if sizes[i]]
    while left > 1e-9 and open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            got[i] += left * weights[i] / total
        left = sum(max(0.0, got[i] - cap * sizes[i]) for i in open_)
        got = [min(g, cap * s) for g, s in zip(got, sizes, strict=True)]
        open_ = [i for i in open_ if got[i] < cap * sizes[i] - 1e-9]
    return got


def test_targets():
    for sizes in ([10, 10, 10], [100, 1, 1, 50], [1, 1000, 1, 1], [0, 5, 5], [7], []):
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        got = mixing.targets(sizes, weights, 1.5 * sum(sizes), 2.0)
        assert got == pytest.approx(shares(sizes, weights, 1.5 * sum(sizes), 2.0))


def check(rows, docs, cap=2):
    by_source = {}
    for d in docs:
        by_source.setdefault(d["source"], []).append(size(d["text"]))
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(by_source[s]) for s in order]
    weights = [(3, 1, 2)[i % 3] for i in range(len(order))]
    want = dict(zip(order, shares(sizes, weights, 1.5 * sum(sizes), cap), strict=True))
    of = {d["doc_id"]: d for d in docs}
    taken = dict.fromkeys(order, 0)
    assert len(rows) == len(docs)
    for r in rows:
        d = of[r.doc_id]
        assert r.size == size(d["text"]) and r.taken <= cap * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert r.source_size == sum(by_source[d["source"]])
        assert r.target == pytest.approx(want[d["source"]])
        taken[d["source"]] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s], min([x for x in by_source[s] if x], default=0)), s


def test_documents_reach_targets_and_reruns_agree(spark, sf_dir):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op8_mixing"](spark, sf_dir).collect()
    check(rows, docs)
    again = mixing.accounted(spark.createDataFrame(docs[::-1]).repartition(7))
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string, size long, __u string"
    rows = [(1, "a b c", "x", 1, "p"), (2, None, "x", 1, "p"), (3, "", None, 1, "p"), (4, "w " * 50_000, None, None, None)]
    rows += [(5, "q r", "y", 2, "p")] * 5 + [(None, f"t{i} u v", "z", 2, "p") for i in range(40)]
    df = spark.createDataFrame(rows, schema).drop("__u")
    got = mixing.accounted(df).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 5 for r in got) == 5
    assert {r.doc_id: r.size for r in got}[2] == 0
    z = [r for r in got if r.doc_id is None]
    assert abs(sum(r.taken for r in z) - z[0].target) <= 3
    mix = mixing.mixed(df)
    assert mix.columns == df.columns
    copies = mix.groupBy("doc_id").count().collect()
    want = {}
    for r in mixing.accounted(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert {r.doc_id: r["count"] for r in copies} == {k: v for k, v in want.items() if v}
    assert mixing.accounted(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_shards_split_the_draws(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    many = mixing.Mix(shard_words=5_000, block_docs=2)
    units = mixing._units(docs, many, "doc_id", "text", "source")
    _, blocks = mixing._drawn_blocks(units, many)
    draws = [(r["__s"], r["__pos"], d.epoch, d["__shard"]) for r in blocks.collect() for d in r["__draws"]]
    assert len({d[:3] for d in draws}) == len(draws)
    per_shard = {}
    for d in draws:
        per_shard[d[3]] = per_shard.get(d[3], 0) + 1
    assert max(per_shard.values()) - min(per_shard.values()) <= 2 and len(per_shard) > 10
