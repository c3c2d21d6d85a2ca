"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v and m, the least node among u and its v.

    The minima are partial sums of each task. The join goes by a value that
    Spark doesn't know to be dealt out already, so both its sides are shuffles
    and a node with very many edges can be split over tasks.
    """
    key = F.bitwise_not("u")
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(key.alias("k"), F.least("u", "m").alias("m"))
    return edges.select("u", "v", key.alias("k")).join(least.hint("merge"), "k").select("u", "v", "m")


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other node, and that one on none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up + root > 1").limit(1).count() == 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (the smallest node of its component) for every node of edges (u, v).

    Each round hangs every node on the smallest node near it, until all are
    stars; rounds grow with the logarithm of a component's diameter. Edges are
    written to shared storage after each round.
    """
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not _is_settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        hung = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = scratch.write(hung.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        scratch.drop(now)
        now = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
