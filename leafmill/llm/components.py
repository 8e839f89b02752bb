"""Connected components of an edge table by alternating large and small stars.

Each round replaces edges by edges to the smallest neighbour; labels end at the smallest id of a component after a
number of rounds that grows with the logarithm of its diameter. A round is two aggregations and joins of long pairs,
written to the shared folder, so neither lineage nor the driver grows. Smallest neighbours are found by an aggregation
that combines before the shuffle. Nodes with more than a ``HOT``-th of all edges are fewer than 2 x ``HOT``, by count; they are
broadcast, and their edges are not shuffled to meet them. All others are joined by shuffle, so a node that a third of all edges
meet is no one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._common import written

MOST_ROUNDS = 60

#: A node is hot with more than one part in so many of the edges, and more than ``LEAST_HOT`` of them.
HOT, LEAST_HOT = 4096, 256


def _star(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """One star step over ``count`` edges (u, v) with u > v.

    Large: every neighbour greater than u is tied to the smallest of u and its neighbours. Small: u and its smaller
    neighbours are.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    near = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = near.select(F.col("u").alias("c"), F.least("u", "m").alias("m"), (F.col("n") > max(LEAST_HOT, count // HOT)).alias("hot"))
    # both directions together are 2 x count rows, so fewer than 2 x HOT of their nodes are hot
    hot = F.broadcast(least.where("hot").select(F.col("c").alias("h"), F.col("m").alias("hm")))
    marked = both.join(hot, F.col("u") == F.col("h"), "left")
    met = marked.where("h IS NOT NULL").select("u", "v", F.col("hm").alias("m"))
    met = met.unionByName(marked.where("h IS NULL").join(least.where("NOT hot"), F.col("u") == F.col("c")).select("u", "v", "m"))
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node id) of every node that has an edge; ``edges``: a, b, in any order, repeats allowed."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        # of each node: its ties to smaller ones, and whether greater ones are tied to it
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("all"))
        count, loose = degrees.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("up") < F.col("all"))))).first()
        if not loose:  # stars, all of them
            break
        now = written(_star(written(_star(now, True, count), "large"), False, count), "stars")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
