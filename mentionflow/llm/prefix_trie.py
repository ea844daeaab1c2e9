"""The trie of conversations: what their beginnings have in common, and what sharing them would save.

1. A turn becomes a label, 128 bits of SHA-256 over role and text, and its number of words; texts
   are not shuffled. Turns are numbered by a scan over ranges of (conversation, turn): tasks number
   what they hold, one row per task tells what runs on into the next, so that a conversation may
   span any number of tasks.
2. A second scan of this kind gives every prefix a key, a polynomial over its labels modulo
   2^127 - 1; equal prefixes are equal keys. Nodes are groups of keys, summed within tasks first.
3. A node is named by its smallest member and its depth: a conversation owns at most one node of
   each depth, so names are unique. Sorted by name the nodes are cut into shards of bounded size;
   even a conversation of any length is cut.
4. Time-forward processing: within a shard, nodes sorted by reverse level order take the totals that
   their children have sent from a priority queue, and send their own to the parent. The queue
   spills to Spark's local folders. Nodes whose parent lies in another shard, the shard's roots,
   send theirs out.
5. Across shards the nodes that get such totals form a smaller tree: each one's parent is that of
   its shard's root. The same procedure gives its totals, sharded again while it is large, and a
   second run within the shards adds them.
6. The conversations that end at a node are sorted by range and joined to pieces of text, which are
   hashed in order; members are never gathered.

Defined results: null roles and texts are empty; null turns come first; rows of equal conversation
and turn are ordered by label; a conversation without id is none, its rows are left out; repeated rows are turns like others; other columns don't matter;
without conversations there are no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionflow.session import checkpointed

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix key").digest()[:15], "big")
KEY_BYTES = 16
ROOT_KEY = bytes(KEY_BYTES)
SHARD_NODES = 250_000
QUEUED = 100_000  # messages a queue keeps in memory
PIECE_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    named = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], [n for n, _ in named])


# --- numbered turns and keys of prefixes ------------------------------------------------------------

_SCANNED = "shard int, conv_id long, rank long, key binary, up binary, label binary, words long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and key of each turn, as far as this task's rows tell."""
    shard, conv, rank, key = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        convs, labels = batch["conv_id"].to_pylist(), batch["label"].to_pylist()
        ranks, keys, ups = [], [], []
        for c, label in zip(convs, labels, strict=True):
            if c != conv:
                conv, rank, key = c, 0, 0
            ups.append(key.to_bytes(KEY_BYTES, "big"))
            key = (key * BASE + int.from_bytes(label, "big")) % PRIME
            keys.append(key.to_bytes(KEY_BYTES, "big"))
            rank += 1
            ranks.append(rank)
        yield _batch(_SCANNED, [[shard] * len(convs), convs, ranks, keys, ups, labels, batch["words"].to_pylist()])


def _carried(tails: list) -> dict[int, tuple[int, int, int]]:
    """{shard: (conversation, turns, key)} of what earlier shards hold of a shard's first conversation."""
    found, open_ = {}, None
    for row in sorted(tails, key=lambda r: r["shard"]):
        if open_ is not None and open_[0] == row["first"]:
            found[row["shard"]] = open_
        last = row["last"]
        turns, key = last["rank"], int.from_bytes(last["key"], "big")
        if row["shard"] in found and last["conv_id"] == row["first"]:
            _, before, start = found[row["shard"]]
            turns, key = before + turns, (start * pow(BASE, last["rank"], PRIME) + key) % PRIME
        open_ = last["conv_id"], turns, key
    return found


def scanned(rows: DataFrame, *order: str) -> DataFrame:
    """(conv_id, rank, key, up, label, words) of rows (conv_id, label, words, ...): the number of a
    turn in its conversation, sorted by ``order``, and the keys of the prefixes with and without it."""
    placed = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    found = checkpointed(placed.select("conv_id", "label", "words").mapInArrow(_scan, _SCANNED))
    tails = found.groupBy("shard").agg(
        F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "rank", "key")).alias("last")
    )
    carried = _carried(tails.collect())  # a row per task

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch["shard"].to_pylist()
            if not any(s in carried for s in set(shards)):
                yield batch
                continue
            columns = [c.to_pylist() for c in batch.columns]
            _, convs, ranks, keys, ups, _, _ = columns
            for i, s in enumerate(shards):
                if s in carried and carried[s][0] == convs[i]:
                    _, turns, start = carried[s]
                    for side, k in ((keys, ranks[i]), (ups, ranks[i] - 1)):
                        moved = start * pow(BASE, k, PRIME) + int.from_bytes(side[i], "big")
                        side[i] = (moved % PRIME).to_bytes(KEY_BYTES, "big")
                    ranks[i] += turns
            yield _batch(_SCANNED, columns)

    return (found.mapInArrow(carry, _SCANNED) if carried else found).drop("shard")


def labelled(
    turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, rank, label, words): the turns of every conversation, numbered from 1."""
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    digest = F.sha2(F.concat(*[F.sha2(F.encode(c, "UTF-8"), 256) for c in named]), 256)
    rows = turns.select(
        F.col(f"`{id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.substring(digest, 1, 2 * KEY_BYTES)).alias("label"),
        F.regexp_count(named[1], F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.filter("conv_id is not null")
    return scanned(rows, "turn", "label", "row").select("conv_id", "rank", "label", "words")


def with_shared_heads(turns: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations begun like another one: the first ``head`` turns (a bounded number) are those of
    the conversation ``base``, or fewer if it has fewer; a conversation's own turns behind ``head``
    follow. Both are expressions over conv_id. Gives the turns, and all conversations' conv_id."""
    turns = checkpointed(turns)
    sizes = checkpointed(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    wanted = sizes.select("conv_id", head.cast("long").alias("head"), base.cast("long").alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    wanted = wanted.join(bases, "base", "left")
    wanted = checkpointed(wanted.withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0)))))
    most = wanted.agg(F.max("head")).first()[0] or 0
    heads = turns.filter(F.col("rank") <= most).withColumnRenamed("conv_id", "base")
    begun = wanted.join(heads, "base").filter("rank <= taken").select("conv_id", "rank", "label", "words")
    own = turns.join(wanted.select("conv_id", "head", "taken"), "conv_id").filter("rank > head")
    own = own.select("conv_id", (F.col("rank") - F.col("head") + F.col("taken")).alias("rank"), "label", "words")
    return begun.union(own), sizes.select("conv_id")


# --- conversations that end at a node -----------------------------------------------------------

_PIECES = "depth long, key binary, first long, n long, piece binary"
_ENDS = "depth long, key binary, n_ends long, ends_sha256 string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of conversations of one node as comma-joined text."""
    node, ids, size, rows, held = None, [], 0, [], 0

    def close() -> None:
        nonlocal ids, size, held
        if ids:
            text = ",".join(map(str, ids)).encode()
            rows.append((*node, ids[0], len(ids), text))
            held += len(text) + 64
        ids, size = [], 0

    for batch in batches:
        for depth, key, conv in zip(*(batch[c].to_pylist() for c in ("depth", "key", "conv_id")), strict=True):
            if (depth, key) != node or size > PIECE_BYTES:
                close()
                node = depth, key
            ids.append(conv)
            size += 21
            if held > PIECE_BYTES:
                yield _batch(_PIECES, list(zip(*rows, strict=True)))
                rows.clear()
                held = 0
    close()
    if rows:
        yield _batch(_PIECES, list(zip(*rows, strict=True)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, n, digest = None, 0, None
    for batch in batches:
        rows = []
        for depth, key, k, piece in zip(*(batch[c].to_pylist() for c in ("depth", "key", "n", "piece")), strict=True):
            if (depth, key) != node:
                if node is not None:
                    rows.append((*node, n, digest.hexdigest()))
                node, n, digest = (depth, key), 0, hashlib.sha256()
            elif n:
                digest.update(b",")
            digest.update(piece)
            n += k
        if rows:
            yield _batch(_ENDS, list(zip(*rows, strict=True)))
    if node is not None:
        yield _batch(_ENDS, [[v] for v in (*node, n, digest.hexdigest())])


def _ends(last: DataFrame) -> DataFrame:
    """(depth, key, n_ends, ends_sha256) of rows (depth, key, conv_id)."""
    order = ["depth", "key", "conv_id"]
    pieces = last.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(_pieces, _PIECES)
    return pieces.repartition("depth", "key").sortWithinPartitions("depth", "key", "first").mapInArrow(_hashed, _ENDS)


# --- time-forward processing ----------------------------------------------------------------------


class SpillingQueue:
    """A priority queue of tuples of five long integers, least first; all but ``most`` lie on disk as sorted runs."""

    ROW = struct.Struct("<5q")

    def __init__(self, most: int = QUEUED) -> None:
        self.most, self.heap, self.runs = most, [], []

    def push(self, item: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        folder = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None
        file = tempfile.TemporaryFile(dir=folder)
        for item in sorted(self.heap):
            file.write(self.ROW.pack(*item))
        self.heap = []
        file.seek(0)
        self._head(len(self.runs), file)

    def _head(self, run: int, file) -> None:
        raw = file.read(self.ROW.size)
        if raw:
            heapq.heappush(self.runs, (self.ROW.unpack(raw), run, file))
        else:
            file.close()

    def first(self) -> tuple[int, ...] | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, run, file = heapq.heappop(self.runs)
            self._head(run, file)
            return item
        return heapq.heappop(self.heap)


# up_owner, up_depth: the parent, null at a root; leaves, saved: a node's own, or with what it gets
_TOTALS = "owner long, depth long, children long, leaves long, saved long"
_EXITS = "owner long, depth long, up_owner long, up_depth long, leaves long, saved long"


def _upward(bounds: dict[int, tuple], outside: bool):
    """A task that passes totals from children to parents; its rows are sorted by shard, then deepest
    first. Gives each node's totals, or with ``outside`` what is sent to parents in other shards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, SpillingQueue()
        for batch in batches:
            rows = []
            columns = ("shard", "owner", "depth", "up_owner", "up_depth", "children", "leaves", "saved")
            for s, owner, depth, up_owner, up_depth, children, leaves, saved in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if s != shard:
                    shard, (low, high) = s, bounds[s]
                while (first := queue.first()) is not None and first[:2] == (-depth, -owner):
                    _, _, k, more, spared = queue.pop()
                    children, leaves, saved = children + k, leaves + more, saved + spared
                if up_owner is not None:
                    if low <= (up_owner, up_depth) <= high:
                        queue.push((-up_depth, -up_owner, 1, leaves, saved))
                    elif outside:
                        rows.append((up_owner, up_depth, 1, leaves, saved))
                if not outside:
                    rows.append((owner, depth, children, leaves, saved))
            if rows:
                yield _batch(_TOTALS, list(zip(*rows, strict=True)))

    return task


def _downward(bounds: dict[int, tuple]):
    """A task that tells where the way up from each marked node leaves its shard; its rows are sorted
    by shard, then by depth. A shard's nodes are bounded."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, exits = None, {}
        for batch in batches:
            rows = []
            columns = ("shard", "owner", "depth", "up_owner", "up_depth", "in_leaves", "in_saved")
            for s, owner, depth, up_owner, up_depth, leaves, saved in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if s != shard:
                    shard, exits, (low, high) = s, {}, bounds[s]
                up = (up_owner, up_depth)
                if up_owner is not None and low <= up <= high:
                    up = exits[up]
                exits[owner, depth] = up
                if leaves is not None:
                    rows.append((owner, depth, *up, leaves, saved))
            if rows:
                yield _batch(_EXITS, list(zip(*rows, strict=True)))

    return task


def subtree_sums(nodes: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(owner, depth, children, leaves, saved): number of children, and totals over the subtree, of nodes
    (owner, depth, up_owner, up_depth, leaves, saved), whose parents are less deep."""
    n = nodes.count()
    shards = max(1, -(-n // shard_nodes))
    placed = nodes.withColumn("children", F.lit(0).cast("long"))
    if shards == 1:
        placed = placed.withColumn("shard", F.lit(0)).repartition(1)
        bounds = {0: ((-(1 << 63), -1), ((1 << 63) - 1, (1 << 63) - 1))}
        return placed.sortWithinPartitions("shard", F.desc("depth"), F.desc("owner")).mapInArrow(_upward(bounds, False), _TOTALS)
    placed = checkpointed(placed.repartitionByRange(shards, "owner", "depth").withColumn("shard", F.spark_partition_id()))
    name = F.struct("owner", "depth")
    rows = placed.groupBy("shard").agg(F.min(name).alias("low"), F.max(name).alias("high")).collect()  # a row per shard
    bounds = {r["shard"]: (tuple(r["low"]), tuple(r["high"])) for r in rows}

    def by_level(rows: DataFrame, *order: Column) -> DataFrame:
        return rows.repartition(shards, "shard").sortWithinPartitions("shard", *order)

    reverse = F.desc("depth"), F.desc("owner")
    sent = by_level(placed, *reverse).mapInArrow(_upward(bounds, True), _TOTALS).groupBy("owner", "depth").agg(
        F.sum("children").alias("in_children"), F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved")
    )
    placed = checkpointed(placed.join(sent, ["owner", "depth"], "left"))
    across = checkpointed(by_level(placed, F.col("depth"), F.col("owner")).mapInArrow(_downward(bounds), _EXITS))
    totals = subtree_sums(across, shard_nodes).select("owner", "depth", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    got = placed.join(totals, ["owner", "depth"], "left")
    zero = F.lit(0)
    got = got.withColumns({
        "children": F.coalesce("in_children", zero).cast("long"),
        "leaves": F.col("leaves") + F.coalesce("all_leaves", zero), "saved": F.col("saved") + F.coalesce("all_saved", zero),
    })
    return by_level(got, *reverse).mapInArrow(_upward(bounds, False), _TOTALS)


def trie(turns: DataFrame, conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The nodes of the trie of turns (conv_id, rank, label, words), ranks from 1 without gaps, and of
    all ``conversations`` (conv_id, distinct), those without turns included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    paths = checkpointed(scanned(turns.withColumnRenamed("rank", "at"), "at").withColumnRenamed("rank", "depth"))
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("end")).select("end.depth", "end.key", "conv_id")
    bare = conversations.join(last.select("conv_id"), "conv_id", "left_anti")
    last = last.union(bare.select(F.lit(0).cast("long"), F.lit(ROOT_KEY), "conv_id"))
    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT_KEY).alias("key"), "n_convs", "owner", F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("words"))
    groups = paths.groupBy("depth", "key").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.max("up").alias("up"), F.max("words").alias("words")
    )
    nodes = checkpointed(groups.unionByName(root).join(_ends(last), ["depth", "key"], "left"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("owner").alias("up_owner"))
    nodes = checkpointed(nodes.join(above, ["depth", "up"], "left").select(
        "owner", "depth", "up_owner", F.when(F.col("up_owner").isNotNull(), F.col("depth") - 1).alias("up_depth"), "n_convs",
        (F.coalesce("n_ends", F.lit(0)) == F.col("n_convs")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    ))
    totals = subtree_sums(nodes.select("owner", "depth", "up_owner", "up_depth", "leaves", "saved"), shard_nodes)
    rows = nodes.select("owner", "depth", "up_owner", "n_convs", "ends_sha256").join(totals, ["owner", "depth"])
    return rows.select(
        F.col("owner").alias("conv_id"), "depth", F.col("up_owner").alias("parent_conv_id"), "n_convs",
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
