"""Bounded reachability over edges(src, dst): one join a hop, from a frontier that only holds nodes not seen before.

Null ends never match. Unknown seeds reach nothing. Repeated edges change nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cheap, written


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(node, next): `out` follows edges, `in` goes against them, `both` does either."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    return {"out": out, "in": back}[direction] if direction != "both" else out.union(back)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", seeds_seen: bool = True) -> DataFrame:
    """(node, depth) of all nodes within `depth` hops of seeds(node), each at its least depth of one or more.

    seeds_seen: seeds are never results; else a seed on a cycle comes back as any other node.
    """
    steps = _oriented(edges, direction)
    steps = steps if depth < 2 or cheap(steps) else written(steps.distinct())
    seeds = written(seeds.select(F.col(seeds.columns[0]).cast(steps.schema["node"].dataType).alias("node")).distinct())
    hops, seen, frontier = [], [seeds] if seeds_seen else [], seeds
    for hop in range(1, depth + 1):
        found = steps.join(frontier, "node").select(F.col("next").alias("node")).where("node is not null").distinct()
        for before in seen:
            found = found.join(before, "node", "left_anti")
        frontier = written(found)
        if frontier.isEmpty():
            break
        seen.append(frontier)
        hops.append(frontier.withColumn("depth", F.lit(hop)))
    return reduce(DataFrame.unionByName, hops) if hops else seeds.withColumn("depth", F.lit(0)).limit(0)


def k_hop(edges: DataFrame, node, depth: int, direction: str = "out") -> DataFrame:
    """Nodes within depth hops of one node; the node itself if it lies on such a cycle. No node for depth 0 or less."""
    start = edges.sparkSession.createDataFrame([(node,)], ["node"])
    return reach(edges, start, depth, direction, seeds_seen=False)


def blast_radius(edges: DataFrame, changed: list, max_depth: int = 10) -> DataFrame:
    """(node, depth) of all that depends on the changed nodes, which are never in it."""
    seeds = edges.sparkSession.createDataFrame([(x,) for x in changed], ["node"]) if changed else edges.select(F.col("src").alias("node")).limit(0)
    return reach(edges, seeds, max_depth, "in")


def variable_length(edges: DataFrame, node, least: int, most: int, direction: str = "out", rel: str | None = None) -> DataFrame:
    """Nodes at a shortest distance from least to most hops, without the node itself; rel: only edges of this type."""
    edges = edges if rel is None else edges.where(F.col("rel") == rel)
    return k_hop(edges, node, most, direction).where(F.col("depth").between(least, most) & (F.col("node") != F.lit(node)))
