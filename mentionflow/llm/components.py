"""Connected components of a graph of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionflow.session import checkpointed

MAX_ROUNDS = 100
ROWS_PER_TASK = 200_000
HOT_ROWS = 100
HOT_NODES = 100


def compacted(df: DataFrame, rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df``, of so many rows, in no more tasks than it needs: a shuffle's files grow with its tasks."""
    return df.coalesce(max(1, -(-rows // rows_per_task)))


def _state(edges: DataFrame) -> tuple[int, bool]:
    """(rows, whether they are stars: each u has one edge and is no other's v). Stars of least nodes don't change any more."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    rows, moving = nodes.agg(F.sum("out"), F.max((F.col("out") > 0) & (F.col("out") + F.col("into") > 1))).first()
    return rows or 0, not moving


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): ``edges``, of so many rows, with the least neighbour of u.

    Nodes of more than a hundredth of all rows are fewer than ``HOT_NODES``, so their least
    neighbours are broadcast and their edges stay where they are; other edges are shuffled."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    crowded = F.col("n") > max(HOT_ROWS, rows // HOT_NODES)
    hot = least.filter(crowded).select("u", F.col("m").alias("hot"))
    marked = edges.join(F.broadcast(hot), "u", "left")
    rest = marked.filter("hot is null").select("u", "v").join(least.filter(~crowded).select("u", "m"), "u")
    return marked.filter("hot is not null").select("u", "v", F.col("hot").alias("m")).union(rest.select("u", "v", "m"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour instead."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both, 2 * rows).filter("v > u")
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    moved = _with_least(edges, rows).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(edges.groupBy("u").agg(F.min("v").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge to another.

    Each round is stored in the shared folder. Rounds grow with the logarithm of the number of
    nodes; ids may be any longs, and null ends and loops are left out. ``rows``: a bound of the edges, if known."""
    stars = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stars = checkpointed(stars if rows is None else compacted(stars, rows))
    for _ in range(MAX_ROUNDS):
        rows, settled = _state(stars)
        stars = compacted(stars, rows)
        if settled:
            break
        large = checkpointed(compacted(_large_star(stars, rows), 2 * rows))  # stored, as the next step reads it several times
        stars = checkpointed(compacted(_small_star(large, rows), rows))
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
