"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one kept per group.

1. Equal vectors of a label are one class; copies are counted, not compared.
2. Centroids are fitted by spherical k-means on at most SAMPLE vectors; every vector is assigned.
3. A vector is at home in its nearest cell, and visits each cell that is at most the threshold's
   angle farther. If two vectors lie within that angle, the one farther from its own home visits
   the home of the other: angles obey the triangle inequality. So no link is lost to cells, and a
   pair is counted only in the home of the vector that is nearer to it.
4. A cell is cut into blocks; pairs of blocks are multiplied in double precision. A product counts
   links and sends on one edge per vector, to the least of those it is connected with in the block.
5. Components of these edges are groups; the least vec_id of a group is kept.

Only vectors of one label, not null, are compared, and only if they have as many components.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing, and so do those without label or id; rows that repeat an id are one vector that links with
what any of them links with; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionflow.llm.components import connected_components
from mentionflow.session import checkpointed

SAMPLE = 20_000  # vectors that centroids are fitted on, at most,
SAMPLE_VALUES = 1 << 22  # and numbers in them
MAX_CELLS = 4_096
FUZZ = 1e-6  # radians; rounding never hides a visit


@dataclass(frozen=True)
class Near:
    cosine: float = 0.98
    cell_rows: int = 1_000
    block_rows: int = 1_024
    rounds: int = 8
    seed: int = 11


def fitted(vectors: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids by spherical k-means; ``vectors`` are of unit length."""
    rng = np.random.default_rng(seed)
    centroids = vectors[np.sort(rng.choice(len(vectors), k, replace=False))]
    for _ in range(rounds):
        home = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, vectors)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centroids)
    return centroids


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    rows = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _classes(df: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(all rows, comparable vectors with their copies); ``key`` names a class among the rows."""
    rows = df.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{embedding}`").cast("array<double>").alias("v"),
        F.col(f"`{label}`").cast("string").alias("label"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite
    rows = rows.withColumn("usable", F.coalesce(usable & F.exists("v", lambda x: x != 0), F.lit(False)))
    vectors = rows.filter("usable").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    return rows.select("vec_id", "usable", F.when(F.col("usable"), F.struct("label", "v")).alias("of")), vectors


def _assigned(vectors: DataFrame, near: Near) -> DataFrame:
    """A row per vector and cell it is at home in or visits."""
    spark = vectors.sparkSession
    vectors = vectors.withColumn("dim", F.size("v"))
    counts = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim, n = (counts["dim"], counts["count"]) if counts else (1, 0)
    order = [F.xxhash64(F.lit(near.seed), "id", "label"), F.col("id")]
    most = max(1, min(SAMPLE, SAMPLE_VALUES // dim))
    drawn = vectors.filter(F.col("dim") == dim).orderBy(*order).limit(most).select("v").toArrow()["v"].combine_chunks()
    sample = _matrix(drawn, dim)
    k = max(1, min(MAX_CELLS, len(sample), math.ceil(n / near.cell_rows)))
    if len(sample):
        centroids = fitted(sample, k, near.rounds, near.seed)
    else:
        centroids = np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(centroids)  # at most MAX_CELLS rows
    margin = math.acos(near.cosine) + FUZZ
    names = ["id", "copies", "label", "dim", "v"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch["dim"])
            cell, home, angle, row = [], [], [], []
            here = np.flatnonzero(dims == dim)
            for part in np.array_split(here, max(1, math.ceil(len(here) / 2_000))):
                if not len(part):
                    continue
                m = _matrix(batch["v"].take(pa.array(part)), dim)
                angles = np.arccos(np.clip(m @ shared.value.T, -1, 1))
                nearest = np.argmin(angles, axis=1)
                least = angles[np.arange(len(part)), nearest]
                i, c = np.nonzero(angles <= least[:, None] + margin)
                row.append(part[i]), cell.append(c), home.append(nearest[i]), angle.append(least[i])
            rest = np.flatnonzero(dims != dim)  # of another length: one cell per label and length
            row.append(rest), cell.append(np.zeros(len(rest), int)), home.append(np.zeros(len(rest), int)), angle.append(np.zeros(len(rest)))
            row, cell, home, angle = (np.concatenate(x) for x in (row, cell, home, angle))
            chosen = batch.select(names).take(pa.array(row))
            extra = [pa.array(cell, pa.int32()), pa.array(home, pa.int32()), pa.array(angle, pa.float64())]
            yield pa.RecordBatch.from_arrays([*chosen.columns, *extra], [*names, "cell", "home", "angle"])

    schema = "id long, copies long, label string, dim int, v array<double>, cell int, home int, angle double"
    return vectors.select(*names).mapInArrow(task, schema)


def _rooted(adjacent: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name each row is connected with."""
    low = names.copy()
    largest = np.iinfo(np.int64).max
    while True:
        new = np.minimum(low, np.where(adjacent, low[None, :], largest).min(axis=1, initial=largest))
        if (new == low).all():
            return low
        low = new


def _compared(near: Near):
    def product(table: pa.Table) -> pa.Table:
        """Links within two blocks, i and j, or one: their counts, and edges that connect them."""
        table = table.combine_chunks()
        column = {c: np.asarray(table[c]) for c in ("id", "copies", "home", "angle", "cell", "block", "i", "j", "dim")}
        m = _matrix(table["v"].chunk(0), int(column["dim"][0]))
        cosine = m @ m.T
        linked = cosine >= near.cosine
        np.fill_diagonal(linked, False)
        # counted where the vector nearer to its home is at home
        own = column["home"] == column["cell"]
        angle, ids = column["angle"], column["id"]
        first = (angle[:, None] < angle[None, :]) | ((angle[:, None] == angle[None, :]) & (ids[:, None] <= ids[None, :]))
        linked &= np.where(first, own[:, None], own[None, :])
        # and in the block pair that is theirs: a block's own pairs only with itself
        if column["i"][0] != column["j"][0]:
            linked &= column["block"][:, None] != column["block"][None, :]
        some = np.flatnonzero(linked.any(axis=1))
        counts = linked[some] @ column["copies"]
        roots = _rooted(linked[np.ix_(some, some)], ids[some])
        return pa.table({"id": ids[some], "links": counts.astype(np.int64), "root": roots})

    return product


def _same_ids(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b): ties from ids that several vectors share to the classes of all of them."""
    mine = rows.filter("usable").select("vec_id", "of")
    key = F.xxhash64("of")
    several = mine.groupBy("vec_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).filter("low != high").select("vec_id")
    several = checkpointed(several)
    if not several.head(1):
        return rows.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b")).limit(0)
    classes = vectors.select(F.struct("label", "v").alias("of"), F.col("id").alias("b"))
    return mine.join(several, "vec_id").join(classes, "of").select(F.col("vec_id").alias("a"), "b").distinct()


def grouped(
    df: DataFrame, near: Near = Near(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """A row per row of ``df``: vec_id, n_links, component_id and kept."""
    rows, vectors = _classes(df, vec_id, embedding, label)
    vectors = checkpointed(vectors)
    assigned = _assigned(vectors, near)
    cell = ["label", "dim", "cell"]
    blocks = F.ceil(F.col("members") / near.block_rows)
    sizes = assigned.groupBy(*cell).agg(F.count("*").alias("members")).select(*cell, blocks.alias("blocks"))
    dealt = assigned.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("id", F.lit(near.seed)), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = checkpointed(dealt.groupBy(*cell, "i", "j").applyInArrow(_compared(near), "id long, links long, root long"))

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(_same_ids(rows, vectors))
    labels = connected_components(edges)
    # ids that several vectors share, being repeated, join their groups
    named = vectors.select("label", "v", "id", "copies").join(counts, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = named.select(
        F.struct("label", "v").alias("of"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    result = rows.join(named, "of", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
