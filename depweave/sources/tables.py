"""Graphs and corpora derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph of parts: from a line to the next line number of its order, for small quantities."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    edges = line.where("l_quantity < 10").join(after, ["l_orderkey", "l_linenumber"]).where(F.col("l_partkey") != F.col("dst"))
    return edges.select(F.col("l_partkey").alias("src"), "dst").distinct()


def geo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, label, kind, name, size) and CONTAINS edges of regions, nations, customers and suppliers."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, key, label, kind, name, size: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node_id"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.col(name).alias("name"), size.cast("double").alias("size"))
    nodes = node(t("region"), "r_regionkey", "File", "region", "r_name", F.lit(0)).union(node(t("nation"), "n_nationkey", "Class", "nation", "n_name", F.lit(0)))
    nodes = nodes.union(node(t("customer"), "c_custkey", "Method", "customer", "c_name", F.col("c_acctbal"))).union(node(t("supplier"), "s_suppkey", "Function", "supplier", "s_name", F.col("s_acctbal")))
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(f"{a}:"), F.col(x).cast("string")).alias("src"), F.concat(F.lit(f"{b}:"), F.col(y).cast("string")).alias("dst"), F.lit("CONTAINS").alias("rel"))
    edges = edge(t("nation"), "region", "n_regionkey", "nation", "n_nationkey").union(edge(t("customer"), "nation", "c_nationkey", "customer", "c_custkey")).union(edge(t("supplier"), "nation", "s_nationkey", "supplier", "s_suppkey"))
    return nodes, edges


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, href): the links of each page."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
