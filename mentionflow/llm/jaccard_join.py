"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct word shingles; two link when the Jaccard similarity of their sets
reaches a threshold. Sets are compared through prefixes in one order of all shingles, the rarest
first: two linked sets share at least m shingles within prefixes of ``size - least overlap + m``.
Each document chooses its own m by estimated cost: a longer prefix reads more list entries, but
only partners with that many matches have to be verified. A pair must match min(m, m') times.

1. Equal sets are one class; copies are not compared, and copies of a text not read again.
2. Sets that share too few shingles within their prefixes to reach the threshold with anybody are done
   (``partners``). Of the others a count-min sketch tells which shingles may be in two of them. One that is in no other cannot
   match, comes first in the order and is left out of the index; sets with too few others are done as well. What is left is stored.
   The sketch is bounded, but few sets come so far, and most of their shingles are shared.
3. Frequencies of stored shingles are estimated by hashed counts; they order the prefixes.
4. Components grow by stars: in each list of the index, entries pair with the least one only, and
   each class verifies its best pair. So a group of thousands of near copies costs one pair each.
5. What is left is exact: every candidate pair whose ends are still in separate components is
   verified. Pairs within a component could not change it. Lists with many such pairs are joined
   into families and compared in blocks, so that no pair but a link leaves a task.

Defined results: null and empty texts have an empty set and link with nothing; a text of fewer
words than a shingle is one shingle; rows that repeat an id are one document that links when any of
its texts does; null ids are never the name of a component, which is null if it has no other; other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionflow.llm import partners, sketch
from mentionflow.llm.components import compacted, connected_components
from mentionflow.llm.wordhash import mix, slices, words_of
from mentionflow.session import checkpointed


SKETCH_BITS = 3 << 27  # at most; a shingle taken for shared by mistake only costs time
MARKS_PER_ROW = 3  # hashes that a row counts as where the sketch tells rows apart: 12 bits


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 80  # least Jaccard similarity
    most_matches: int = 8
    star_rounds: int = 2
    pair_rows: int = 10_000  # of a list; beyond, its classes are compared in blocks
    verify_cost: float = 0.25  # of one verification, per shingle, against reading a list entry

    def least_overlap(self, n):
        """Shingles that a set of n must share with any partner."""
        return -(-self.percent * n // 100)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, shingles): the sorted distinct shingle hashes of each text."""
    found = words_of(texts, lower=True)
    counts = found.counts
    at, hashes = found.runs(words, 0)
    places, tokens = [np.searchsorted(found.first, at, side="right") - 1], [hashes]
    for few in range(1, words):  # whole texts of fewer words
        if (counts == few).any():
            at, hashes = found.runs(few, 0)
            place = np.searchsorted(found.first, at, side="right") - 1
            whole = counts[place] == few
            places.append(place[whole])
            tokens.append(mix(hashes[whole] ^ np.uint64(few)))
    place, token = np.concatenate(places), np.concatenate(tokens)
    order = np.lexsort((token, place))
    place, token = place[order], token[order]
    if len(place):
        keep = np.concatenate([[True], (place[1:] != place[:-1]) | (token[1:] != token[:-1])])
        place, token = place[keep], token[keep]
    return np.searchsorted(place, np.arange(len(counts) + 1)), token


def _set_keys(offsets: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set, sums over its shingles."""
    keys = []
    for salt in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + salt), dtype=np.uint64)])
        keys.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return keys


def _rows(docs: DataFrame) -> DataFrame:
    """(id, h1, h2, own, text): h1 and h2 stand for a text, ``own`` for a row."""
    same = F.sha2("text", 256)
    rows = docs.select("id", F.xxhash64(same).alias("h1"), F.xxhash64(F.lit(1), same).alias("h2"), "text")
    return rows.select("id", "h1", "h2", F.xxhash64("h1", "h2", "id").alias("own"), "text")


def _among(rows: DataFrame, count: int):
    """Whether rows may be among these, by ``own``; some others are taken for them."""
    shape = sketch.Shape.of(MARKS_PER_ROW * count, SKETCH_BITS)

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.asarray(batch["own"]).view(np.uint64)

    bits = rows.sparkSession.sparkContext.broadcast(sketch.repeated_bits(rows.select("own"), hashes_of, shape, 1))
    return lambda batch: sketch.may_repeat(bits.value, shape, np.asarray(batch["own"]).view(np.uint64))


def _texts(docs: DataFrame, rows: DataFrame, n_rows: int, join: Join) -> tuple[DataFrame, int]:
    """(a row per distinct text, their number): its least id, n, keys of its set, and whether that may link.

    Copies of a text are not cut into shingles again."""
    kept = rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.first("size").alias("size"))
    count, size = kept.agg(F.count("*"), F.sum("size")).first()
    wanted = _among(kept.select(F.xxhash64("h1", "h2", "least").alias("own")), count)
    found = partners.judged(docs, wanted, lambda texts: shingle_sets(texts, join.words), _set_keys, join.percent, (size or 0) // 6)
    # rows that come twice, and copies that were taken for first ones, are there several times
    texts = found.groupBy("h1", "h2", "n", "k1", "k2").agg(F.min("id").alias("least"), F.max("may").alias("may"))
    return checkpointed(compacted(texts, n_rows)), count


def _tokens(docs: DataFrame, chosen: DataFrame, join: Join) -> DataFrame:
    """(k1, k2, n, tokens): of the sets of these texts that may link, the shingles that may be shared among them."""
    count, hashes = chosen.agg(F.count("*"), F.sum("n")).first()
    wanted = _among(chosen.select(F.xxhash64("h1", "h2", "least").alias("own")), count)
    shape = sketch.Shape.of(hashes or 0, SKETCH_BITS)

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in slices(batch.filter(pa.array(wanted(batch))), "text"):
            yield shingle_sets(part["text"], join.words)[1]

    bits = docs.sparkSession.sparkContext.broadcast(sketch.repeated_bits(docs.select("own", "text"), hashes_of, shape))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(pa.array(wanted(batch))), "text"):
                offsets, tokens = shingle_sets(part["text"], join.words)
                n = np.diff(offsets)
                shared = sketch.may_repeat(bits.value, shape, tokens)
                total = np.concatenate([[0], np.cumsum(shared)])
                have = total[offsets[1:]] - total[offsets[:-1]]
                may_link = (n > 0) & (have >= join.least_overlap(n))
                ends = np.concatenate([[0], np.cumsum(have[may_link])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[shared & np.repeat(may_link, n)].view(np.int64)))
                k1, k2 = _set_keys(offsets, tokens)
                columns = [pa.array(x[may_link]) for x in (k1, k2, n)]
                yield pa.RecordBatch.from_arrays([*columns, lists], ["k1", "k2", "n", "tokens"])

    return docs.select("own", "text").mapInArrow(task, "k1 long, k2 long, n long, tokens array<long>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets)
    return offsets - offsets[0], np.asarray(column.flatten()).view(np.uint64)


def _index(classes: DataFrame, join: Join) -> DataFrame:
    """(token, node, n, m): the prefixes of all classes, the rarest shingles first."""

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _lists(batch["tokens"])[1]

    counts = sketch.hashed_counts(classes.select("tokens"), hashes_of)
    counts = classes.sparkSession.sparkContext.broadcast(counts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, tokens = _lists(batch["tokens"])
            often = sketch.estimated(counts.value, tokens)
            nodes, sizes = (np.asarray(batch[c]) for c in ("node", "n"))
            found = []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                n, have = int(sizes[i]), int(b - a)
                length, m = _prefix(np.sort(often[a:b]), n, have, join)
                if length > 0:
                    chosen = a + np.lexsort((tokens[a:b], often[a:b]))[:length]
                    found.append((tokens[chosen].view(np.int64), np.full(length, nodes[i]), np.full(length, n), np.full(length, m, np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["token", "node", "n", "m"])

    return classes.select("node", "n", "tokens").mapInArrow(task, "token long, node long, n long, m int")


def _prefix(often: np.ndarray, n: int, have: int, join: Join) -> tuple[int, int]:
    """(length, m) of the cheapest prefix among the ``have`` indexed shingles of a set of n.

    ``often``: their sorted frequencies. The n - have others are in no second set and come first.
    Reading the lists costs their entries. A candidate needs m of them, so there are at most
    entries / m candidates, each to be verified."""
    first = n - join.least_overlap(n) + 1 - (n - have)
    read = np.concatenate([[0], np.cumsum(often - 1)])
    best = None
    for m in range(1, join.most_matches + 1):
        length = first + m - 1
        if length > have or m > join.least_overlap(n):
            break
        cost = read[max(0, length)] * (1 + join.verify_cost * n / m)
        if best is None or cost < best[0]:
            best = cost, length, m
    return (best[1], best[2]) if best else (0, 1)


def _verified(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The (a, b) of ``pairs`` that link, by exact intersection of their sets."""
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("both", both)
    return rows.filter(100 * F.col("both") >= join.percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b").distinct()


def _similar_sizes(a: str, b: str, join: Join):
    return 100 * F.least(a, b) >= join.percent * F.greatest(a, b)


def _labelled(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries with their component, of lists that hold more than one component."""
    if labels is None:
        index = index.withColumn("c", F.col("node"))
    else:
        index = index.join(labels.select("node", F.col("component").alias("l")), "node", "left")
        index = index.withColumn("c", F.coalesce("l", "node")).drop("l")
    mixed = index.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("token")
    return index.join(mixed, "token", "left_semi")


def _star_pairs(entries: DataFrame, join: Join, step: int) -> DataFrame:
    """For each entry's class the pair with most matches among those with one entry of a list.

    The entry that the others pair with is another one in every round."""
    turn = F.xxhash64(F.lit(step), "node")
    pivots = entries.groupBy("token").agg(F.min(F.struct(turn.alias("turn"), "c", "node", "n")).alias("p"))
    pairs = entries.join(pivots, "token").filter(F.col("c") != F.col("p.c")).filter(_similar_sizes("n", "p.n", join))
    pairs = pairs.groupBy("c", "node", F.col("p.node").alias("b")).agg(F.count("*").alias("matches"))
    best = pairs.groupBy("c", "node").agg(F.max(F.struct("matches", "b")).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.b").alias("b"))


def _with_major(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` with the largest component of their group, and how many rows are outside it."""
    sizes = rows.groupBy(group, "c").agg(F.count("*").alias("k"))
    largest = sizes.groupBy(group).agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("members"))
    largest = largest.select(group, F.col("top.c").alias("major"), (F.col("members") - F.col("top.k")).alias("minors"), "members")
    return rows.join(largest, group)


def _cross_pairs(entries: DataFrame, join: Join) -> DataFrame:
    """All candidate pairs between different components in these lists.

    In each list, entries outside its largest component pair with all others, so that the members
    of a large component are not run through against each other."""
    minor = entries.filter("c != major").select("token", *[F.col(x).alias(f"{x}1") for x in ("node", "n", "m", "c")])
    pairs = minor.join(entries, "token").filter("c1 != c and (c = major or node1 < node)").filter(_similar_sizes("n1", "n", join))
    pairs = pairs.groupBy(F.least("node1", "node").alias("a"), F.greatest("node1", "node").alias("b")).agg(
        F.count("*").alias("matches"), F.min(F.least("m1", "m")).alias("m")
    )
    return pairs.filter("matches >= m")


def _spanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each end of the links (a, b) to the least end it is connected with: no more than ends."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, least = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        lower = least.copy()
        np.minimum.at(lower, x, least[y])
        np.minimum.at(lower, y, least[x])
        lower = lower[lower]
        if np.array_equal(lower, least):
            break
        least = lower
    moved = least != np.arange(len(names))
    return names[least[moved]], names[moved]


def _products(join: Join):
    """Compares a block of minors with a block of a family by chunked products of their sets."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, sizes, parts, minor = (np.asarray(table[x]) for x in ("node", "n", "c", "is_minor"))
        offsets, tokens = _lists(table["tokens"].chunk(0))
        rows, others = np.flatnonzero(minor), np.flatnonzero(~minor)
        kinds, column = np.unique(tokens, return_inverse=True)
        row = np.repeat(np.arange(len(nodes)), np.diff(offsets))
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(rows), len(others)), np.float32)
        cuts = np.searchsorted(column, np.arange(0, len(kinds) + CHUNK_KINDS, CHUNK_KINDS))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            chunk = np.zeros((len(nodes), CHUNK_KINDS), np.float32)
            chunk[row[a:b], column[a:b] - k * CHUNK_KINDS] = 1
            both += chunk[rows] @ chunk[others].T  # whole numbers below 2**24 per set, exact in float32
        union = sizes[rows][:, None] + sizes[others][None, :] - both.astype(np.int64)
        linked = 100 * both.astype(np.int64) >= join.percent * union
        linked &= parts[rows][:, None] != parts[others][None, :]
        i, j = np.nonzero(linked)
        # one link from a class to each component is enough
        _, first = np.unique(np.stack([i, parts[others][j]]), axis=1, return_index=True)
        a, b = _spanned(nodes[rows][i[first]], nodes[others][j[first]])
        return pa.table({"a": a, "b": b})

    return compare


CLASSES_PER_TASK = 2_000
CHUNK_KINDS = 2_048
FAMILY_BLOCK = 256


def _family_links(entries: DataFrame, suspects: DataFrame, join: Join, rows: int) -> DataFrame:
    """Links between components within these lists, without a row per pair.

    Lists that share a class form a family. Its classes outside its largest component are compared,
    in blocks, with all of its classes; links alone leave a task. ``rows``: a bound of the entries."""
    heads = entries.groupBy("token").agg(F.min("node").alias("head"))
    ties = entries.join(heads, "token").select("node", "head").distinct()
    # a class is tied to the least of its heads, and so are its other heads: few of these ties differ
    least = ties.groupBy("node").agg(F.min("head").alias("b"))
    others = ties.join(least, "node").select(F.col("head").alias("a"), "b")
    ties = others.union(least.select(F.col("node").alias("a"), "b")).distinct()
    families = connected_components(checkpointed(compacted(ties, rows)), rows=rows)
    members = entries.groupBy("node").agg(F.first("c").alias("c")).join(families, "node")
    members = _with_major(members.withColumnRenamed("component", "family"), "family").join(suspects, "node")
    blocks = lambda n: F.ceil(F.col(n) / FAMILY_BLOCK)
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n))
    through = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    columns = ["family", "node", "n", "c", "tokens"]
    minor = members.filter("c != major").select(*columns, F.lit(True).alias("is_minor"), own("minors").alias("i"), through("members").alias("j"))
    every = members.filter("minors > 0").select(*columns, F.lit(False).alias("is_minor"), own("members").alias("j"), through("minors").alias("i"))
    dealt = minor.unionByName(every)
    return dealt.groupBy("family", "i", "j").applyInArrow(_products(join), "a long, b long")


@dataclass(frozen=True)
class _Prepared:
    rows: DataFrame  # (id, h1, h2) of each row
    n_rows: int
    texts: DataFrame
    classes: DataFrame  # a row per distinct set; ``node`` is its least id, or a hash where it has none
    suspects: DataFrame  # classes that may link
    n_suspects: int
    index: DataFrame
    n_index: int


def _prepared(df: DataFrame, join: Join, doc_id: str, text: str) -> _Prepared:
    """What is stored before the join. A stored part is a file and its checksum, so frames of known size
    have no more parts than their rows need."""
    docs = _rows(df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")))
    rows = checkpointed(docs.select("id", "h1", "h2", F.octet_length("text").alias("size")))
    n_rows = rows.count()
    texts, n_texts = _texts(docs, rows, n_rows, join)
    classes = texts.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("least").alias("least"), F.max("may").alias("may"))
    classes = checkpointed(compacted(classes.withColumn("node", F.coalesce("least", "k1")), n_texts))
    chosen = texts.filter("may").groupBy("k1", "k2", "n").agg(F.min(F.struct("h1", "h2", "least")).alias("first")).select("n", "first.*")
    chosen = checkpointed(compacted(chosen, n_texts))
    found = _tokens(docs, chosen, join).groupBy("k1", "k2", "n").agg(F.first("tokens").alias("tokens"))
    found = found.join(classes.filter("may").select("k1", "k2", "n", "node"), ["k1", "k2", "n"]).select("node", "n", "tokens")
    suspects = checkpointed(compacted(found, chosen.count(), CLASSES_PER_TASK))
    n_suspects = suspects.count()
    suspects = compacted(suspects, n_suspects, CLASSES_PER_TASK)
    index = checkpointed(_index(suspects, join))
    n_index = index.count()
    return _Prepared(rows, n_rows, texts, classes, suspects, n_suspects, compacted(index, n_index), n_index)


def _same_ids(p: _Prepared) -> DataFrame:
    """(a, b): ties between the classes of ids that several texts share."""
    mine = p.rows.filter("id is not null").select("id", "h1", "h2")
    several = mine.groupBy("id").agg(*[f(h).alias(f"{f.__name__}_{h}") for f in (F.min, F.max) for h in ("h1", "h2")])
    several = checkpointed(compacted(several.filter("min_h1 != max_h1 or min_h2 != max_h2").select("id"), p.n_rows))
    if not several.head(1):
        return p.classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    sets = p.texts.filter("n > 0").select("h1", "h2", "k1", "k2").join(p.classes.select("k1", "k2", "node"), ["k1", "k2"])
    nodes = mine.join(several, "id").distinct().join(sets, ["h1", "h2"]).select("id", "node").distinct()
    least = nodes.groupBy("id").agg(F.min("node").alias("a"))
    return nodes.join(least, "id").filter("node != a").select("a", F.col("node").alias("b"))


MOST_WORDS = 1 << 18
IDS_PER_WORD = 4


def _stars(labels: DataFrame) -> DataFrame:
    return labels.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def linked_pairs(df: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole join: (a, b), a < b, for every linked pair of different sets, by their least ids."""
    p = _prepared(df, join, doc_id, text)
    return _verified(_cross_pairs(_with_major(_labelled(p.index, None), "token"), join), p.suspects, join)


def grouped(df: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``df``: doc_id, n_shingles and component_id, the least id reachable by links."""
    p = _prepared(df, join, doc_id, text)
    classes, suspects, index = p.classes, p.suspects, p.index
    labels = None
    for step in range(join.star_rounds):
        # components so far are stars of a class and its name, so earlier links needn't be run through again
        # stored, as plans of all steps at once would take much of the driver's memory
        pairs = checkpointed(compacted(_star_pairs(_labelled(index, labels), join, step), p.n_index))
        new = compacted(_verified(pairs, suspects, join), p.n_suspects, CLASSES_PER_TASK)
        links = checkpointed(new if labels is None else new.union(_stars(labels)))
        n_links = links.count()
        labels = connected_components(compacted(links, n_links), rows=n_links)
    entries = checkpointed(compacted(_with_major(_labelled(index, labels), "token"), p.n_index))
    n_entries = entries.count()
    entries = compacted(entries, n_entries)
    long = F.col("minors") * F.col("members") > join.pair_rows
    pairs = checkpointed(_cross_pairs(entries.filter(~long), join))
    n_pairs = pairs.count()
    few = checkpointed(compacted(_verified(compacted(pairs, n_pairs), suspects, join), n_pairs, CLASSES_PER_TASK))
    many = checkpointed(_family_links(entries.filter(long).select("token", "node", "c"), suspects, join, n_entries))
    links = _stars(labels).union(few).union(many).union(_same_ids(p))
    # stars have an edge of each class at most, and ids no more than rows
    labels = connected_components(links, rows=2 * p.n_rows + n_pairs + many.count())
    nodes = classes.select("k1", "k2", "node", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # the name of a component is its least real id, not a hash
    named = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(named, "component").select("k1", "k2", "component_id")
    texts = p.texts.select("h1", "h2", "n", "k1", "k2").join(nodes, ["k1", "k2"], "left").select("h1", "h2", "n", "component_id")
    rows = p.rows.select("id", "h1", "h2").join(texts, ["h1", "h2"], "left")
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not an ``__id`` of ``gone``; null keys stay.

    Two bits of a word mark each id of ``gone``, and the words, ``MOST_WORDS`` at most, are broadcast. Rows without
    the marks stay where they are; only others, with their texts, are shuffled to be compared exactly."""
    words, ids = 1, gone.count()
    while words < min(MOST_WORDS, ids // IDS_PER_WORD):
        words *= 2

    def bits(of: Column) -> Column:
        first, second = (F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(of, F.lit(n)), F.lit(64)).cast("int")) for n in (1, 2))
        return first.bitwiseOR(second)

    def place(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(words))

    marks = gone.groupBy(place(F.col("__id")).alias("__at")).agg(F.bit_or(bits(F.col("__id"))).alias("__marks"))
    rows = df.withColumns({"__id": key, "__at": place(key)}).join(F.broadcast(marks), "__at", "left")
    own = bits(F.col("__id"))
    marked = F.coalesce(F.col("__marks").bitwiseAND(own) == own, F.lit(False))
    unsure = rows.filter(marked).join(gone, "__id", "left_anti")
    return rows.filter(~marked).drop("__id", "__at", "__marks").union(unsure.drop("__id", "__at", "__marks"))


def representatives(df: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose id names their component, with the columns of ``df``.

    Rows without an id are kept, as nothing tells which of them to keep."""
    least = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    named = grouped(df, join, doc_id, text).filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(least).alias("kept"))
    gone = checkpointed(compacted(named.filter("not kept").select("__id"), df.count()))
    key = F.col(f"`{doc_id}`").cast("long")
    return _without(df.filter(key.isNotNull() | F.col(f"`{doc_id}`").isNull()), key, gone)
