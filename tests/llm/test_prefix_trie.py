import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mentionflow.llm import prefix_trie
from mentionflow.llm.prefix_trie import SpillingQueue
from mentionflow.llm.queries import QUERIES
from mentionflow.llm.tables import table
from tests.llm.brute import WORD, rebuilt


def label(role, text):
    hexed = [hashlib.sha256(x.encode()).hexdigest() for x in (role, text)]
    return hashlib.sha256("".join(hexed).encode()).hexdigest()[:32]


def conversations(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, label(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in found.items()}


def brute(paths):
    members, children, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for conv, path in paths.items():
        for depth in range(len(path) + 1):
            members[tuple(path[:depth])].append(conv)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = set()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(paths[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out.add((
            min(convs), len(node), up, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()
        ))
    return out


def trie(df, **options):
    turns = prefix_trie.labelled(df)
    rows = prefix_trie.trie(turns, turns.select("conv_id").distinct(), **options).collect()
    assert len(rows) == len({(r.conv_id, r.depth) for r in rows})
    return set(map(tuple, rows))


def odd_rows():
    rng = random.Random(3)
    ids = [None, -(1 << 62), -45, -21, 0, 1, 2, 5, 21, 40, 41, 59, 60, (1 << 62)]
    rows = [
        (rng.choice(ids), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "a"]), rng.choice([None, "", "x y", "b"])) for _ in range(250)
    ]
    rows += [(77, i, "u", f"t {i // 3}") for i in range(400)] + [(78, i, "u", f"t {i // 3}") for i in range(300)]
    rows += [(1000 + i, 0, "system", "the same for all") for i in range(300)] + [(1000 + i, 1, "user", f"ask {i % 7}") for i in range(200)]
    return rows


@pytest.mark.parametrize("shard_nodes", [250_000, 23])
def test_odd_rows_equal_brute_force(spark, shard_nodes):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, owner string")
    assert trie(df.repartition(5), shard_nodes=shard_nodes) == brute(conversations(rows))


def test_a_conversation_over_many_tasks(spark):
    rows = [(5, i, "u", str(i % 10)) for i in range(3000)] + [(9, i, "u", str(i % 10)) for i in range(2000)] + [(1, 0, "u", "0")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(df, shard_nodes=500) == brute(conversations(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_conversations_without_turns_and_empty_tables(spark):
    turns = prefix_trie.labelled(spark.createDataFrame([(4, 0, "u", "a b")], "conv_id long, turn long, role string, text string"))
    got = {tuple(r) for r in prefix_trie.trie(turns, spark.createDataFrame([(4,), (2,), (3,)], "conv_id long")).collect()}
    assert got == brute({4: [("u", "a b")], 2: [], 3: []})
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie(none) == set()
    assert trie(spark.createDataFrame([(None, 1, "u", "x")], none.schema)) == set()


def test_spilling_queue_keeps_order():
    rng, queue, held = random.Random(4), SpillingQueue(most=10), []
    for _ in range(2000):
        if held and rng.random() < 0.4:
            held.sort()
            assert queue.first() == held[0] and queue.pop() == held.pop(0)
        else:
            item = tuple(rng.randint(-9, 9) for _ in range(5))
            queue.push(item)
            held.append(item)
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.first() is None


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_prefix_trie"](spark, sf_dir)
    assert set(map(tuple, got.collect())) == brute(rebuilt(conversations(rows)))


def test_shared_heads_of_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    head, base = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 4, F.expr("conv_id - conv_id % 20")
    got = prefix_trie.trie(*prefix_trie.with_shared_heads(prefix_trie.labelled(df), head, base), shard_nodes=50)
    assert set(map(tuple, got.collect())) == brute(rebuilt(conversations(rows)))
