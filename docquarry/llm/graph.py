"""Connected components of an edge table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, written

#: Rounds by the nodes' own order.
ROUNDS = 4


def components(edges: DataFrame, stored: bool = False) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is one node of its component.

    Edges that are `stored` are a written table without repeats and with a < b;
    it is read as it is, and kept.

    In each round a node points at its least neighbour if that is less than
    itself, edges are carried over to what their ends point at, and those within
    one node vanish.  The first ROUNDS go by the nodes' own order, which ends
    stars at once; after them the order is drawn anew in each round, so that
    each is expected to take away a constant share of the nodes whatever their
    names.  Points are aggregated in each task before they shuffle; edges of a
    hub are a skewed key of a sort-merge join, which adaptive execution splits.
    Rounds are written to the shared folder; edges never reach the driver.
    """
    left = edges if stored else written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    chain: DataFrame | None = None
    turn = 0
    while not left.isEmpty():
        turn += 1
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if turn <= ROUNDS:
            least = F.least(F.col("a"), F.min("b"))
        else:
            place = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("place"), F.col(c).alias("node"))
            least = F.least(place("a"), F.min(place("b")))["node"]
        points = written(both.groupBy("a").agg(least.alias("to")).withColumnRenamed("a", "node"), "points")
        step_a = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        step_b = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        carried = left.join(step_a, "a").join(step_b, "b").where("x <> y")
        after = written(carried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if chain is None:
            chain = points.select("node", F.col("to").alias("root"))
        else:
            on = points.select(F.col("node").alias("root"), "to")
            longer = written(chain.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            drop(chain)
            drop(points)
            chain = longer
        if left is not edges:
            drop(left)
        left = after
    if left is not edges:
        drop(left)
    if chain is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return chain
