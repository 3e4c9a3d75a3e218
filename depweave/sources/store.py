"""Graphs of repositories as Parquet tables, partitioned by a hash of the repository's root."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import repo_hash
from ..operators import graph, search
from ..operators._shared import written

SCHEMA = {
    "repos": "root_path string, indexed_at timestamp, repo_hash string",
    "nodes": "root_path string, node_id string, label string, kind string, language string, name string, file_path string, start_line long, end_line long, content string, is_exported boolean, owner_name string, scope_refs array<string>, dsl_macro string, repo_hash string",
    "edges": "src string, dst string, rel string, repo_hash string",
    "postings": "node_id string, label string, kind string, dl int, term string, tf int, repo_hash string",
    "embeddings": "node_id string, embedding array<float>, repo_hash string",
}


class GraphStore:
    """save() replaces a repository's partitions and leaves the others alone; reads prune to the asked-for one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def read(self, name: str, root: str | None = None) -> DataFrame:
        fs, path = self._path(name)
        if not fs.exists(path):
            rows = self.spark.createDataFrame([], SCHEMA[name])
        else:
            rows = self.spark.read.schema(SCHEMA[name]).parquet(f"{self.folder}/{name}")
        return rows if root is None else rows.where(F.col("repo_hash") == self.hash(root))

    def hash(self, root: str) -> str:
        return hashlib.sha256(root.encode()).hexdigest()[:16]

    def _write(self, rows: DataFrame, name: str, root: str) -> None:
        fields = [f for f in self.spark.createDataFrame([], SCHEMA[name]).schema if f.name != "repo_hash"]
        have = dict(rows.dtypes) | ({} if name != "nodes" else {"root_path": "string"})
        rows = rows.withColumn("root_path", F.lit(root)) if name == "nodes" else rows
        full = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], repo_hash(F.lit(root)).alias("repo_hash"))
        full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_hash").parquet(f"{self.folder}/{name}")

    def save(self, root: str, nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None) -> None:
        """nodes: node_id, kind, ...; edges: src, dst, rel. Unknown kinds, repeated ids and edges between labels that are no pair are left out.

        All is computed and written aside before anything stored is touched, so frames loaded from the store can be saved into it.
        The repository's row goes first and comes back last: what a broken run leaves counts as not stored.
        """
        known = graph.with_label(nodes.drop("label"))
        rest = [c for c in known.columns if c != "node_id"]
        first = known.groupBy("node_id").agg(F.min(F.struct("kind", *[c for c in rest if c != "kind"])).alias("r"))
        nodes = written(first.select("node_id", *[F.col("r").getField(c).alias(c) for c in rest]))
        edges = written(graph.last_write(graph.allowed(edges.select("src", "dst", "rel"), nodes.select("node_id", "label")), [F.lit(0).alias("o")]).select("src", "dst", "rel"))
        have = [c for c in ("name", "file_path", "content") if c in nodes.columns]
        words = search.postings(nodes.withColumn("text", F.concat_ws(" ", *have)), "node_id", "text", ["label", "kind"])
        aside = {"nodes": nodes, "edges": edges, "postings": written(words.withColumnRenamed("id", "node_id"))}
        if embeddings is not None:
            aside["embeddings"] = written(embeddings)
        self.delete(root)
        for name, rows in aside.items():
            self._write(rows.sortWithinPartitions("term") if name == "postings" else rows, name, root)
        self._write(self.spark.range(1).select(F.lit(root).alias("root_path"), F.current_timestamp().alias("indexed_at")), "repos", root)

    def load(self, root: str) -> tuple[DataFrame, DataFrame] | None:
        return None if self.read("repos", root).isEmpty() else (self.read("nodes", root), self.read("edges", root))

    def delete(self, root: str) -> bool:
        """False if the repository isn't stored."""
        found = not self.read("repos", root).isEmpty()
        for name in sorted(SCHEMA, key=lambda x: x != "repos"):
            fs, path = self._path(f"{name}/repo_hash={self.hash(root)}")
            fs.delete(path, True)
        return found

    def repos(self) -> DataFrame:
        """root_path, indexed_at, nodes, edges and the count of each label."""
        nodes = self.read("nodes").select(F.col("repo_hash").alias("repo"), "label")
        stats = graph.repo_stats(nodes, self.read("edges").select(F.col("repo_hash").alias("repo")))
        return self.read("repos").join(stats.withColumnRenamed("repo", "repo_hash"), "repo_hash", "left").drop("repo_hash")

    def reset(self) -> None:
        fs, path = self._path("")
        fs.delete(path, True)
