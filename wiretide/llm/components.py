"""Connected components of an edge table, without driver collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges (a, b).

    Alternates large-star and small-star: every node is linked to the smallest of its neighbours and
    itself, first its larger neighbours, then its smaller ones, until every component is a star. The number of
    rounds grows with the logarithm of the longest path. Each round's edges are written to the shared
    folder, so the lineage stays short and a lost executor costs one round. Minima and distinct edges
    are aggregated before they are shuffled; the joins with a node's minimum may be split if skewed.
    Edges with a null end are left out; an edge of a node to itself links nothing and names no node.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    while not _stars(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(down, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        following = materialize(small, "star")
        discard(now)
        now = following
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node either is a root or has one root: edges (a, b) with b < a, none twice."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("int").alias("up")))
    roles = ends.groupBy("node").agg(F.count("up").alias("up"), F.count(F.lit(1)).alias("all"))
    return roles.filter("up > 1 OR (up = 1 AND all > 1)").isEmpty()
