"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Each source gets a target in words: a share of a budget by weight, at most ``cap`` times its
   size; what a capped source cannot take is shared among the others by weight.
2. The documents of a source are dealt into blocks by a hash, and the blocks are permuted. A
   source's draws are the blocks in permuted order, over and over; its quota is how many draws
   reach its target. The last draw takes part of its block, so that words come near the target.
3. The quotas of all sources are split over the output shards by a binary tree: at each node the
   left half gets a multivariate-hypergeometric sample of the node's draws, without replacement.
   So every draw falls into exactly one shard, and a shard holds a random sample of the mix. A
   leaf needs only the nodes on its path, so leaves are computed apart from each other.
4. Documents follow their block's draws to shards and are shuffled there by a hash.

Only source totals (bounded by MAX_SOURCES rows) come to the driver. Everything depends on the rows
and the seed alone, so reruns agree however the rows are partitioned.

Defined results: a null source is a source of its own, last in order; null and empty texts have
size 0 and are dealt like others; rows equal in id, source and text are one unit and are drawn
together; an empty table gives no rows; other columns pass through ``mixed``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionflow.session import checkpointed

MAX_SOURCES = 1_000_000
MAX_BLOCKS = 1 << 18  # of one source
MAX_ALL_BLOCKS = 1 << 28  # so that quotas stay below what numpy's generators take
EXTRAS = 64  # documents of the last block among which those nearest to the target are chosen
CHUNK = 4096


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order, null last."""

    weights: Sequence[float] = (3, 1, 2)
    share: float = 1.5  # of all words
    cap: float = 2.0  # times a source's own words
    seed: int = 7
    block_docs: int = 32
    shard_words: int = 1_000_000


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, cap: float) -> list[float]:
    """Shares of ``budget`` by weight, none above ``cap`` times its size."""
    result, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while free:
        total = sum(weights[i] for i in free)
        share = {i: left * weights[i] / total if total else 0.0 for i in free}
        full = [i for i in sorted(free) if share[i] > cap * sizes[i]]
        if not full:
            for i in free:
                result[i] = share[i]
            break
        for i in full:
            result[i] = cap * sizes[i]
            left -= result[i]
            free.remove(i)
    return result


def _permutation(n: int, seed: int, source: int) -> tuple[int, int]:
    """Factor and shift of a permutation x -> (x * factor + shift) mod n."""
    rng = np.random.default_rng([seed, source])
    factor = int(rng.integers(1, n)) if n > 2 else 1
    while math.gcd(factor, n) != 1:
        factor = factor % n + 1
    return factor, int(rng.integers(0, n)) if n else 0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _keyed(df: DataFrame, mix: Mix, doc_id: str, text: str, source: str) -> DataFrame:
    """``df`` as columns id, source, size, and ``u``, a hash by which a unit is dealt."""
    i, t, s = (F.col(f"`{c}`") for c in (doc_id, text, source))
    return df.withColumns({
        "__id": i, "__source": s.cast("string"), "__size": n_words(t),
        "__u": F.xxhash64(F.lit(mix.seed), i.isNull(), i, F.xxhash64(t)),
    })


def _order(u: Column, mix: Mix) -> Column:
    """Order within a block; apart from the bits that chose the block."""
    return F.xxhash64(F.lit(mix.seed + 1), u)


def _sources(units: DataFrame, mix: Mix) -> pd.DataFrame:
    """A row per source; at most MAX_SOURCES."""
    totals = units.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__n")).alias("size"), F.count("*").alias("units"))
    rows = totals.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r["size"]) for r in rows]
    weights = [float(mix.weights[n % len(mix.weights)]) for n in range(len(rows))]
    most = max(1, min(MAX_BLOCKS, MAX_ALL_BLOCKS // max(1, len(rows))))
    out = []
    for n, (row, target) in enumerate(zip(rows, targets(sizes, weights, mix.share * sum(sizes), mix.cap), strict=True)):
        blocks = max(1, min(most, math.ceil(row["units"] / mix.block_docs)))
        epochs = min(int(mix.cap), int(target // sizes[n])) if sizes[n] else 0
        factor, shift = _permutation(blocks, mix.seed, n)
        out.append((n, row[0], sizes[n], target, blocks, factor, shift, epochs, max(0.0, target - epochs * sizes[n])))
    names = ["__s", "__source", "__source_size", "__target", "__blocks", "__factor", "__shift", "__epochs", "__rest"]
    return pd.DataFrame(out, columns=names)


SOURCE_SCHEMA = (
    "__s int, __source string, __source_size long, __target double, __blocks long, __factor long, __shift long, "
    "__epochs long, __rest double"
)


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns and the permuted place of their block."""
    right = sources.withColumnRenamed("__source", "__name")
    joined = rows.join(F.broadcast(right), F.col("__source").eqNullSafe(F.col("__name"))).drop("__name")
    block = F.pmod(F.col("__u"), F.col("__blocks"))
    return joined.withColumn("__pos", F.pmod(block * F.col("__factor") + F.col("__shift"), F.col("__blocks")))


def nearest_subset(words: Sequence[int], target: float) -> list[int]:
    """Indices of the words whose sum is nearest to ``target``, exact up to a millionth of it."""
    scale = max(1, int(target) // 1_000_000)
    sums = [1]  # bit s of sums[k]: some of the first k give s
    for w in words:
        sums.append(sums[-1] | sums[-1] << (int(w) // scale))
    aim = int(target / scale + 0.5)
    below = sums[-1] & ((1 << (aim + 1)) - 1)
    above = sums[-1] >> aim
    low = below.bit_length() - 1
    high = aim + (above & -above).bit_length() - 1 if above else None
    best = low if high is None or aim - low <= high - aim else high
    chosen = []
    for k in range(len(words), 0, -1):
        if not sums[k - 1] >> best & 1:
            chosen.append(k - 1)
            best -= int(words[k - 1]) // scale
    return chosen[::-1]


def _last_block(mix: Mix):
    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        """Which units of a source's last block are taken: up to ``cut`` in order, and ``extras``."""
        rows = rows.sort_values(["v", "u"], kind="stable")
        words, left = rows["words"].to_numpy(), float(rows["left"].iloc[0])
        n = max(0, int(np.searchsorted(np.cumsum(words), left, side="right")) - EXTRAS // 2)
        left -= float(words[:n].sum())
        chosen = nearest_subset(words[n : n + EXTRAS].tolist(), left)
        cut = int(rows["v"].iloc[n - 1]) if n else None
        extras = [int(rows["u"].iloc[n + i]) for i in chosen]
        return pd.DataFrame({"__s": [rows["s"].iloc[0]], "__cut": pd.array([cut], "Int64"), "__extras": [extras]})

    return pick


def _split(mix: Mix, quotas: np.ndarray, shards: int):
    """Leaves of the tree: (shard, source, first draw, draws)."""

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                low, high, colors, start = 0, shards, quotas.copy(), np.zeros_like(quotas)
                while high - low > 1:
                    middle, total = (low + high) // 2, int(colors.sum())
                    rng = np.random.default_rng([mix.seed, low, high])
                    draw = total * (middle - low) // (high - low)
                    left = rng.multivariate_hypergeometric(colors, draw, method="marginals")
                    if shard < middle:
                        high, colors = middle, left
                    else:
                        low, start, colors = middle, start + left, colors - left
                some = np.flatnonzero(colors)
                yield pd.DataFrame({"__shard": shard, "__s": some.astype("int32"), "start": start[some], "n": colors[some]})

    return leaves


def _drawn_blocks(units: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks with their draws); ``units``: __id, __source, __size, __u, __n."""
    spark = units.sparkSession
    table = _sources(units, mix)
    sources = spark.createDataFrame(table.values.tolist(), SOURCE_SCHEMA) if len(table) else spark.createDataFrame([], SOURCE_SCHEMA)
    placed = _placed(units, sources).filter("__rest > 0").withColumn("words", F.col("__size") * F.col("__n"))

    # the last block of each source: the first whose words do not all fit; at most MAX_BLOCKS rows a source
    order = Window.partitionBy("__s").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("__s", "__pos", "__rest").agg(F.sum("words").alias("words"))
    blocks = blocks.withColumn("left", F.col("__rest") - F.coalesce(F.sum("words").over(order), F.lit(0)))
    last = blocks.filter("left > 0").groupBy("__s").agg(
        F.max(F.struct("__pos", "left")).alias("last"),
    ).select("__s", F.col("last.__pos").alias("__pos"), F.col("last.left").alias("left"))
    inside = placed.select("__s", "__pos", "__u", "words").join(F.broadcast(last), ["__s", "__pos"])
    inside = inside.select(F.col("__s").alias("s"), F.col("__u").alias("u"), _order(F.col("__u"), mix).alias("v"), "words", "left")
    picked = inside.groupBy("s").applyInPandas(_last_block(mix), "__s int, __cut long, __extras array<long>")
    ends = checkpointed(last.join(picked, "__s").select("__s", "__pos", "__cut", "__extras"))

    end_of = {r["__s"]: r["__pos"] for r in ends.select("__s", "__pos").collect()}
    quotas = np.array(
        [e * b + (end_of[s] + 1 if s in end_of else 0) for s, e, b in zip(table["__s"], table["__epochs"], table["__blocks"], strict=True)],
        np.int64,
    )
    words = float(table["__target"].sum()) if len(table) else 0.0
    shards = max(1, math.ceil(words / mix.shard_words))
    leaves = spark.range(shards).mapInPandas(_split(mix, quotas, shards), "__shard long, __s int, start long, n long")
    draws = leaves.select("__shard", "__s", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("x"))
    draws = draws.join(F.broadcast(sources.select("__s", "__blocks", "__epochs")), "__s")
    draws = draws.select(
        "__s", F.pmod("x", "__blocks").alias("__pos"), F.floor(F.col("x") / F.col("__blocks")).alias("epoch"), "__shard", "__epochs",
    )
    drawn = draws.groupBy("__s", "__pos", "__epochs").agg(F.sort_array(F.collect_list(F.struct("epoch", "__shard"))).alias("__draws"))
    ended = F.broadcast(ends.withColumn("__ended", F.lit(True)))
    return sources, drawn.join(ended, ["__s", "__pos"], "left").drop("__epochs")


def _with_draws(rows: DataFrame, sources: DataFrame, blocks: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` with ``__draws``, those of their block that take them."""
    joined = _placed(rows, sources).join(blocks, ["__s", "__pos"], "left")
    chosen = (_order(F.col("__u"), mix) <= F.col("__cut")) | F.array_contains("__extras", F.col("__u"))
    dropped = F.col("__ended") & ~F.coalesce(chosen, F.lit(False))
    kept = F.filter("__draws", lambda d: ~F.coalesce(dropped & (d["epoch"] >= F.col("__epochs")), F.lit(False)))
    return joined.withColumn("__draws", F.coalesce(kept, F.array().cast("array<struct<epoch:bigint,__shard:bigint>>")))


def _units(df: DataFrame, mix: Mix, doc_id: str, text: str, source: str) -> DataFrame:
    keyed = _keyed(df, mix, doc_id, text, source)
    return checkpointed(keyed.groupBy("__id", "__source", "__size", "__u").agg(F.count("*").alias("__n")))


def accounted(df: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row per row of ``df``: doc_id, size, source_size, target and taken, in words, and copies."""
    units = _units(df, mix, doc_id, text, source)
    sources, blocks = _drawn_blocks(units, mix)
    rows = _with_draws(units, sources, blocks, mix).withColumn("copies", F.size("__draws").cast("long"))
    # a unit's rows again, in chunks so that no array grows with the number of equal rows
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / CHUNK)))
    rows = rows.withColumn("__chunk", chunk)
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.col("__n") - F.col("__chunk") * CHUNK))))
    return rows.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.col("copies")).alias("taken"), "copies",
    )


def mixed(df: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix: rows of ``df``, a row for each draw, shards apart and shuffled within."""
    units = _units(df, mix, doc_id, text, source)
    sources, blocks = _drawn_blocks(units, mix)
    rows = _with_draws(_keyed(df, mix, doc_id, text, source), sources, blocks, mix)
    rows = rows.withColumn("__draw", F.explode("__draws")).withColumn("__to", F.col("__draw.__shard"))
    mixed_rows = F.xxhash64(F.lit(mix.seed + 2), "__u", "__draw.epoch")
    rows = rows.repartition("__to").sortWithinPartitions("__to", mixed_rows, "__u")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns])
