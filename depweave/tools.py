"""The engine's tools by name: arguments in, plain dictionaries out. Results are collected here and nowhere else.

An error is {"error": message, "code": code}.  Queries have reading clauses only, so nothing they say can change a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import embedding
from .operators import graph, search, traverse
from .operators._shared import written
from .plans.cypher import NotReading
from .plans.cypher import query as run_cypher
from .sources import repository
from .sources.store import GraphStore

#: Arguments by tool with their defaults; those without one are required.
REQUIRED = object()
TOOLS = {
    "index_repo": {"root_path": REQUIRED, "languages": None, "force_reindex": False, "with_symbols": False},
    "get_dependencies": {"root_path": REQUIRED, "file_path": REQUIRED, "depth": 1},
    "get_dependents": {"root_path": REQUIRED, "file_path": REQUIRED, "depth": 1},
    "blast_radius": {"root_path": REQUIRED, "changed_files": REQUIRED, "max_depth": 10},
    "query_graph": {"root_path": REQUIRED, "cypher": REQUIRED},
    "search": {"root_path": REQUIRED, "query": REQUIRED, "limit": 20, "kind": None},
    "get_graph": {"root_path": REQUIRED, "subgraph_paths": None, "max_nodes": 500},
    "list_repos": {},
    "delete_repo": {"root_path": REQUIRED},
    "reset_db": {},
}
#: Kinds that stand for all kinds of their label.
WHOLE_LABEL = {"class": "Class", "method": "Method", "class_method": "Method"}


class ToolError(Exception):
    def __init__(self, message: str, code: str) -> None:
        super().__init__(message)
        self.code = code


class Tools:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, GraphStore(spark, folder)

    def call(self, name: str, args: dict | None = None) -> dict:
        args = args or {}
        if name not in TOOLS:
            return {"error": f"There is no tool {name}", "code": "UNKNOWN_TOOL"}
        for arg, default in TOOLS[name].items():
            if default is REQUIRED and args.get(arg) is None:
                return {"error": f"{name} needs {arg}", "code": "MISSING_PARAM"}
        try:
            return getattr(self, name)(**{k: args.get(k, default) for k, default in TOOLS[name].items()})
        except ToolError as e:
            return {"error": str(e), "code": e.code}
        except Exception as e:  # a caller gets an answer whatever happens
            return {"error": str(e), "code": "TOOL_ERROR"}

    def _graph(self, root: str) -> tuple[DataFrame, DataFrame]:
        found = self.store.load(root)
        if found is None:
            raise ToolError(f"No graph of {root} is stored; index_repo makes one", "REPO_NOT_FOUND")
        return found

    def _counts(self, root: str) -> dict:
        nodes, edges = self._graph(root)
        languages = nodes.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).count().collect()
        at = self.store.read("repos", root).select(F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at")).first()
        return {"nodes": sum(r["count"] for r in languages), "edges": edges.count(), "languages": {r["language"]: r["count"] for r in languages}, "indexed_at": at["at"]}

    def index_repo(self, root_path: str, languages: list[str] | None, force_reindex: bool, with_symbols: bool) -> dict:
        if not force_reindex and self.store.load(root_path):
            return {"status": "already_indexed", **self._counts(root_path), "hint": "force_reindex replaces the stored graph"}
        try:
            nodes, edges = repository.index(self.spark, root_path, languages, with_symbols)
        except (FileNotFoundError, NotADirectoryError) as e:
            raise ToolError(f"{root_path} is no folder", "NOT_FOUND") from e
        nodes = written(nodes)
        self.store.save(root_path, nodes, edges, embedding.index(nodes))
        return {"status": "indexed", "root_path": root_path, **self._counts(root_path)}

    def _near(self, root: str, file: str, depth: int, direction: str, name: str) -> dict:
        nodes, edges = self._graph(root)
        if nodes.where(F.col("node_id") == file).isEmpty():
            raise ToolError(f"{file} is no node of the graph", "NOT_FOUND")
        found = sorted(r["node"] for r in traverse.k_hop(edges, file, depth, direction).select("node").collect())
        return {"file": file, "depth": depth, name: found, "count": len(found)}

    def get_dependencies(self, root_path: str, file_path: str, depth: int) -> dict:
        return self._near(root_path, file_path, depth, "out", "dependencies")

    def get_dependents(self, root_path: str, file_path: str, depth: int) -> dict:
        return self._near(root_path, file_path, depth, "in", "dependents")

    def blast_radius(self, root_path: str, changed_files: list[str], max_depth: int) -> dict:
        found = traverse.blast_radius(self._graph(root_path)[1], changed_files, max_depth).orderBy("depth", "node").collect()
        return {"changed": list(changed_files), "affected": [r["node"] for r in found], "depth_map": {r["node"]: r["depth"] for r in found}, "total": len(found)}

    def query_graph(self, root_path: str, cypher: str) -> dict:
        nodes, edges = self._graph(root_path)
        try:
            rows = [r.asDict(recursive=True) for r in run_cypher(nodes, edges, cypher, {"root": root_path}).collect()]
        except NotReading as e:
            raise ToolError(str(e), "QUERY_NOT_ALLOWED") from e
        except Exception as e:
            raise ToolError(str(e), "QUERY_ERROR") from e
        return {"rows": rows, "count": len(rows)}

    def search(self, root_path: str, query: str, limit: int, kind: str | None) -> dict:
        """Words and vectors, each with more candidates than asked for, fused by rank; words alone where no vectors are stored."""
        nodes = self._graph(root_path)[0]
        such = F.col("label") == WHOLE_LABEL[kind] if kind in WHOLE_LABEL else F.col("kind") == kind if kind in graph.LABELS else F.lit(True)
        n = search.overfetch(limit)
        words = search.top(search.bm25_of(self.store.read("postings", root_path).where(such).withColumnRenamed("node_id", "id"), query), n)
        vectors = self.store.read("embeddings", root_path)
        if not vectors.isEmpty():
            vectors = vectors.join(nodes.where(such).select("node_id"), "node_id", "left_semi")
            best = search.top(search.fused(words, search.top(search.cosine(vectors, embedding.vector(query), "node_id"), n)), limit)
        else:
            best = words.where(F.col("rank") <= limit)
        rows = best.select("id", "score").join(nodes.select(F.col("node_id").alias("id"), "name", "file_path", "kind", "start_line", "end_line"), "id")
        found = sorted((r.asDict() for r in rows.collect()), key=lambda r: (-r["score"], r["id"]))
        return {"results": [r | {"rank": k} for k, r in enumerate(found, 1)], "count": len(found), "query": query}

    def get_graph(self, root_path: str, subgraph_paths: list[str] | None, max_nodes: int) -> dict:
        nodes, edges = self._graph(root_path)
        extra = {}
        if subgraph_paths:
            wanted = self.spark.createDataFrame([(p,) for p in subgraph_paths], "node_id string")
            if gone := sorted(r["node_id"] for r in graph.missing(nodes, wanted).collect()):
                extra["missing_paths"] = gone
            nodes = nodes.join(wanted.distinct(), "node_id", "left_semi")
            edges = graph.induced(edges, nodes)
        elif (total := nodes.count()) > max_nodes:
            hint = f"{total} nodes, of which the first {max_nodes} are listed; name subgraph_paths or ask query_graph for others"
            extra |= {"truncated": True, "total_nodes": total, "total_edges": edges.count(), "hint": hint}
            nodes = graph.truncated(nodes, max_nodes)
            edges = graph.induced(edges, nodes)
        listed = [{k: v for k, v in r.asDict().items() if v is not None} for r in nodes.withColumnRenamed("node_id", "id").drop("root_path", "repo_hash", "label").orderBy("id").collect()]
        return {"nodes": listed, "edges": [{"from": r["src"], "to": r["dst"], "rel": r["rel"]} for r in edges.orderBy("src", "dst").collect()], **extra}

    def list_repos(self) -> dict:
        rows = [r.asDict() for r in self.store.repos().withColumn("indexed_at", F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ss")).orderBy("root_path").collect()]
        labels = ["File", "Function", "Class", "Method"]
        return {"repos": [{k: v for k, v in r.items() if k not in labels} | {"breakdown": {k: r[k] or 0 for k in labels}} for r in rows], "count": len(rows)}

    def delete_repo(self, root_path: str) -> dict:
        if not self.store.delete(root_path):
            raise ToolError(f"No graph of {root_path} is stored", "NOT_FOUND")
        return {"status": "deleted", "root_path": root_path}

    def reset_db(self) -> dict:
        self.store.reset()
        return {"status": "ok", "message": "All graphs are deleted. Run index_repo again for each repository."}
