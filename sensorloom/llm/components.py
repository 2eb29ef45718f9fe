"""Connected components of an edge table by alternating large and small stars.

Rounds of joins and partial aggregates on the edges alone; each round is
written to the shared folder, so lost executors cost no more than a round.
Nothing is collected but two numbers a round (edge count and checksum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_table


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    sym = _both(e)
    least = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (sym.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    far = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return far.union(least.select("a", F.col("m").alias("b")))


def _sum(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return r[0], r[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` (longs) -> ``(node, root)``: the smallest node id of each
    component, for every node that has an edge to another node."""
    e = shared_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _sum(e)
    while before[0]:
        e = shared_table(_small_star(_large_star(e)).distinct(), "edges")
        now = _sum(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
