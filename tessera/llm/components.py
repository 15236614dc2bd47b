"""Connected components by alternating large and small stars (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one greater end at most and none is both a greater and a lesser end: all components are stars."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("child")), F.struct(F.col("b").alias("node"), F.lit(0).alias("child")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.child").alias("children"), F.min("e.child").alias("least"))
    return not nodes.where("children > 1 or (children = 1 and least = 0)").limit(1).count()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links -> (a, b) with b the least node of a's component, for all nodes but the least ones.

    Edges are only moved, never multiplied: there are at most as many as came in.  Each round's edges are
    written; a frequent node is summed before the shuffle and split by adaptive execution in the join.  Greater ends
    come first throughout, so once all components are stars, their centres are the least nodes.
    """
    edges = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    turn = 0
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large, f"large{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = scratch.write(small.where("a <> b").distinct(), f"small{turn}")
        scratch.drop(f"large{turn}", f"small{turn - 1}", "edges")
        turn += 1
    return edges
