"""Connected components of an edge table by alternating star contraction.

Every round replaces the edges by edges that point to smaller nodes; at the end each node
has one edge, to the smallest node of its component. Rounds are written tables, so nothing
depends on executors that may be lost. Nodes are compared and joined, never gathered: a
node with many neighbours is one row of minima on one side of an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    pulled = down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pulled.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a long, b long; a <> b); isolated nodes have no row."""
    e = written(edges.select("a", "b"), "edges")
    before, now = None, _state(e)
    while now != before:
        e = written(_small_star(_large_star(e)), "edges")
        before, now = now, _state(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
