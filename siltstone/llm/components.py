"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, counted, released


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's larger (large-star) or not larger (small-star) neighbours at its least neighbour or itself."""
    if large:
        there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = edges.select(F.explode(F.array(there, back)).alias("edge")).select("edge.a", "edge.b")
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b")


def _starred(edges: DataFrame) -> bool:
    """Whether every node that points at a lesser one has this edge only, so that each component is a star on its least node."""
    leaf = lambda c, is_leaf: F.struct(F.col(c).alias("node"), F.lit(is_leaf).alias("leaf"))
    ends = edges.select(F.explode(F.array(leaf("a", 1), leaf("b", 0))).alias("end")).select("end.node", "end.leaf")
    return not counted(ends.groupBy("node").agg(F.count("*").alias("n"), F.max("leaf").alias("leaf")).where("leaf = 1 and n > 1"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for each node of the edges (a, b) of longs. Other nodes have no row.

    Every step is a map-side minimum and a join that skew handling can split, so no node's neighbours are gathered. The
    steps go on until the edges are stars; each is checkpointed, and the one before it deleted.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _starred(now):
        last = now
        now = checkpointed(_stars(_stars(now, True), False).distinct())
        released(last)
    return now.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component")).distinct()


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """`components` of the edges that led to `found` and of further ones: these are edges between components, which are few."""
    of = lambda s: found.select(F.col("node").alias(s), F.col("component").alias(f"of_{s}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    into = over.select(F.col("node").alias("component"), F.col("component").alias("into"))
    return found.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component")).unionByName(over.join(found, "node", "left_anti"))
