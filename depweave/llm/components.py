"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def _edges(*pairs: tuple[str, str]) -> Column:
    """A row (u, v) for each of these pairs of columns."""
    return F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]))


def _settled(pairs: DataFrame) -> bool:
    """Whether distinct edges (u, v), v < u, are stars: every u has one edge and no v is a u."""
    ends = pairs.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, label) from edges (a, b): label is the smallest node of the component; only nodes with edges.

    Each step is a partially aggregated minimum and a join on the node, which Spark splits where a node is
    hot; rounds grow with the logarithm of a component's size. Every round is written, so lost executors cost no more than it.
    """
    pairs = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(pairs):
        # Large star: every larger neighbour of u goes to the least neighbour of u. There are no more rows than edges; repeated ones go below.
        both = pairs.select(_edges(("u", "v"), ("v", "u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = materialise(large)
        # Small star: u's smaller neighbours and u go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = materialise(large.join(least, "u").select(_edges(("v", "m"), ("u", "m"))).where("u != v").distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) after edges (a, b), a != b, are added to the components that labels holds; only the components that edges touch are walked."""
    ends = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    found = components(between)
    moved = found.select(F.col("node").alias("label"), F.col("label").alias("least"))
    # What has no label yet is its own, so found has it as a node.
    fresh = found.join(labels.select("node"), "node", "left_anti")
    return materialise(labels.join(moved, "label", "left").select("node", F.coalesce("least", "label").alias("label")).union(fresh))
