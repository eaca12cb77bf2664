"""Connected components of an edge table, without a hot key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of an edge (columns ``a``, ``b``, long) with the smallest node it reaches, roots excluded.

    Alternating large-star and small-star steps; the number of rounds grows with the logarithm of the longest path.
    A step hangs the neighbours of a node on its smallest neighbour: the minimum is an aggregate with partial sums, and
    it is stored before it is joined to the edges, so that adaptive execution can split the partition of a hot node.
    Null ends and loops are ignored; an empty table gives an empty result.
    """
    edges = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = staged(
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        drop_staged(edges, least)
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        pairs = large.join(least, "a")
        edges = staged(
            pairs.select(F.explode(F.array(
                F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct(), "small-star")
        drop_staged(large, least)
        before, mark = mark, _mark(edges)
        if before == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
