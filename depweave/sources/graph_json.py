"""Graphs as JSON documents: {"nodes": [{"id", ...}], "edges": [{"from", "to", "rel"}]}, one graph a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHAPE = "nodes array<struct<id string, path string, language string, kind string>>, edges array<struct<`from` string, `to` string, rel string>>"


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Of a node's fields path, language and kind are read: its id, an empty text and `file` where they are missing; an edge without rel is DEPENDS_ON."""
    graphs = spark.read.schema(_SHAPE).json(path, multiLine=True)
    node, edge = graphs.select(F.explode("nodes").alias("n")), graphs.select(F.explode("edges").alias("e"))
    nodes = node.select(F.col("n.id").alias("node_id"), F.coalesce("n.path", "n.id").alias("path"), F.coalesce("n.language", F.lit("")).alias("language"), F.coalesce("n.kind", F.lit("file")).alias("kind"))
    return nodes, edge.select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.coalesce("e.rel", F.lit("DEPENDS_ON")).alias("rel"))


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One document in the folder path. The format holds a graph in one document, so this is for graphs that one task can hold; the graph store has no such bound."""
    node = F.struct(F.col("node_id").alias("id"), *[c for c in nodes.columns if c != "node_id"])
    edge = F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "rel")
    ends = nodes.agg(F.array_sort(F.collect_list(node)).alias("nodes")), edges.agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    both = ends[0].withColumn("one", F.lit(1)).join(ends[1].withColumn("one", F.lit(1)), "one")
    both.select(F.to_json(F.struct("nodes", "edges")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
