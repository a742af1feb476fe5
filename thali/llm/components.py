"""Connected components of a graph given by links, as alternating star contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.llm.common import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of any comparable type to (node, root): root is the least node reachable.

    Large-star hangs every greater neighbour of a node on its least neighbour, small-star
    every smaller one; the two alternate until nothing changes (about the logarithm of the
    longest path). Minima are partial aggregates, and every join is many links to one
    minimum per node, so a node with very many links is split by the skew join and nothing
    multiplies. Each round is checkpointed. Links of a node with itself, repeated links and
    null ends are ignored; nodes without links do not appear.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").alias("x")).filter(
        F.col("x").isNotNull() & F.col("a").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    edges = cut_lineage(edges)
    state = _signature(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = cut_lineage(small)
        before, state = state, _signature(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
