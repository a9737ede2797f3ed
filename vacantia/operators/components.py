"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.staging import Staged, stage

# Each round at least halves the longest path to a root; more rounds than this mean an error.
MOST_ROUNDS = 64


def _write(edges: DataFrame) -> Staged:
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return stage(edges, "components", mark=mark)


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(a, least): written, so that a hub's edges meet it in a join that Spark can split."""
    return stage(edges.groupBy("a").agg(F.min("b").alias("least")), "components-least").table


def _to_least_above(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours under the least node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbour(both)
    least = least.select("a", F.least("a", "least").alias("least"))
    moved = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.distinct()


def _to_least_below(edges: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours and itself under the least of them."""
    least = _least_neighbour(edges)
    joined = edges.join(least, "a")
    moved = joined.where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a neighbour; the component is its least node.

    Alternates two star operations until nothing changes, which takes a number of rounds that grows with the
    logarithm of the longest path. Rows are pairs of nodes only, groups are reduced to their least member by
    aggregation, and every round is written to the shared folder. Pairs with null are ignored.
    """
    x, y = F.col(a), F.col(b)
    edges = pairs.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    now = _write(edges)
    for _ in range(MOST_ROUNDS):
        if not now.rows:
            break
        before = now
        now = _write(_to_least_below(stage(_to_least_above(before.table), "components-above").table))
        if (now.rows, now.seen["mark"]) == (before.rows, before.seen["mark"]):
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.table
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
