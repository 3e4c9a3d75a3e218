"""Graphs of source repositories: files are listed and parsed by Spark, references become edges by joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, language, skipped
from ..operators import graph
from ..operators._shared import written
from . import parsers

FACTS = "file string, place long, fact string, candidates array<string>, src string, dst string, rel string, node_id string, kind string, name string, start_line long, end_line long, content string, owner_name string, is_exported boolean, scope_refs array<string>, dsl_macro string, how string"


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """A store and the path of root in it; a path without a scheme is a local one."""
    local = re.fullmatch(r"(?:file:/*(?=/))?(/.*)", root)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(root)


def files(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """(file, language) of a folder's source files, relative to root, which driver and executors see. Folders of dependencies and builds are left out.

    Only names are listed here. Spark's own readers pass over empty files and names that begin with an underscore, and so every __init__.py.
    """
    store, base = _open(root)
    base = base.rstrip("/")
    found = [(i.path[len(base) + 1 :],) for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file]
    rows = spark.createDataFrame(found, "file string").withColumn("language", language(F.col("file")))
    rows = rows.where(F.col("language").isNotNull() & ~skipped(F.col("file")))
    return rows if languages is None else rows.where(F.col("language").isin(languages))


def _rows(file: str, lang: str, content: bytes, symbols: bool) -> pd.DataFrame:
    fields = [f.split(" ")[0] for f in FACTS.split(", ")]
    found = [{"file": file, "place": k} | f for k, f in enumerate(parsers.facts(file, lang, content, symbols))]
    rows = pd.DataFrame(found, dtype=object).reindex(columns=fields)
    return rows.astype(object).where(rows.notna(), None)


def _parse(root: str, symbols: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(root)
        for batch in batches:
            for file, lang in zip(batch["file"], batch["language"], strict=True):
                try:
                    with store.open_input_stream(f"{base.rstrip('/')}/{file}") as stream:
                        content = stream.read()
                except OSError:  # it stays a node without content
                    continue
                yield _rows(file, lang, content, symbols)

    return run


def parsed(sources: DataFrame, symbols: bool = True) -> DataFrame:
    """The facts of sources that are rows: file, language, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, lang, content in zip(batch["file"], batch["language"], batch["content"], strict=True):
                yield _rows(file, lang, (content or "").encode(), symbols)

    return sources.select("file", "language", "content").mapInPandas(run, FACTS)


def index(spark: SparkSession, root: str, languages: list[str] | None = None, symbols: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a folder. Files that an import names are nodes though their language isn't asked for.

    Of several edges between two nodes the one of the last pass stays: imports, containment and keys, inheritance, names that are used elsewhere, calls.
    """
    every = files(spark, root)
    known = written(every)
    wanted = known if languages is None else known.where(F.col("language").isin(languages))
    facts = written(wanted.mapInPandas(_parse(root, symbols), FACTS))

    refs = facts.where("fact = 'import'").select(F.concat_ws("\n", "file", F.col("place").cast("string")).alias("ref"), "candidates")
    imports = graph.resolve(refs, known.select(F.col("file").alias("target"))).select(F.substring_index("ref", "\n", 1).alias("src"), F.col("target").alias("dst"), F.lit("DEPENDS_ON").alias("rel"), F.lit(1).alias("pass")).where("src != dst").distinct()
    imports = written(imports)
    inside = facts.where("fact = 'edge'").select("src", "dst", "rel", F.lit(2).alias("pass"))
    named = facts.where("fact = 'symbol'").join(known, "file").select("file", "language", "place", "name", "node_id")
    used = written(_used(facts, known, graph.definers(named)))

    linked = imports.union(used.where(~F.col("dst").contains("#"))).select("src", "dst").distinct()
    visible = written(graph.imported_symbols(linked, named.select("file", "name", F.col("node_id").alias("symbol"))).withColumnRenamed("src", "file"))
    asked = facts.where("fact = 'call'").select("file", "src", F.col("name").alias("ref"), "how").distinct()
    straight = asked.where("how = 'imported'").join(visible.withColumnRenamed("name", "ref"), ["file", "ref"]).select("src", "symbol")
    names = visible.select("file", "name", "symbol", F.lit(1).alias("own")).union(named.select("file", "name", F.col("node_id").alias("symbol"), F.lit(0).alias("own")))
    # An exact name is the file's own first, a last segment an imported one first.
    names = names.withColumn("turn", F.when(F.col("name").contains("."), -F.col("own")).otherwise(F.col("own")))
    around = graph.suffix_match(asked.where("how = 'anywhere'").select("file", "src", "ref"), names, ["file"], ["turn"]).select("src", "symbol")
    calls = straight.union(around).distinct().select("src", F.col("symbol").alias("dst"), F.lit("CALLS").alias("rel"), F.lit(6).alias("pass"))

    edges = graph.last_write(imports.union(inside).union(used).union(calls), [F.col("pass").alias("written")]).select("src", "dst", "rel")
    kept = known if languages is None else known.join(known.where(F.col("language").isin(languages)).select("file").union(linked.select(F.col("dst").alias("file"))).distinct(), "file", "left_semi")
    own = kept.join(facts.where("fact = 'file'").select("file", "content"), "file", "left")
    own = own.select(F.col("file").alias("node_id"), F.lit("file").alias("kind"), "language", basename(F.col("file")).alias("name"), F.col("file").alias("file_path"), "content")
    columns = ["kind", "language", "name", "start_line", "end_line", "content", "owner_name", "is_exported", "scope_refs", "dsl_macro"]
    symbol = facts.where("fact = 'node'").join(known.withColumn("language", F.when(F.col("language") == "javascript", "typescript").otherwise(F.col("language"))), "file").withColumn("first", F.struct("place", *columns))
    symbol = symbol.groupBy("node_id", F.col("file").alias("file_path")).agg(F.min_by("first", "place").alias("f")).select("node_id", "file_path", *[F.col("f").getField(c).alias(c) for c in columns])
    return own.unionByName(symbol, allowMissingColumns=True), edges


def _used(facts: DataFrame, known: DataFrame, definers: DataFrame) -> DataFrame:
    """Edges (src, dst, rel, pass) of names that are used where another file defines them: between the files, and from the symbol that uses one."""
    refs = facts.where("fact = 'ref'").select("file", "src", "name", "how").distinct().join(known, "file").join(definers, "name")
    target = F.when(F.col("language") == "ruby", F.col("first")).otherwise(F.col("first_script"))
    between = refs.select(F.col("file").alias("src"), target.alias("dst"), F.lit("DEPENDS_ON").alias("rel"), F.lit(4).alias("pass")).where("src != dst")
    parents = refs.where("how = 'inherits' and symbol != src").select("src", F.col("symbol").alias("dst"), F.lit("INHERITS").alias("rel"), F.lit(3).alias("pass"))
    abroad = refs.where("how != 'inherits' and symbol_file != file and contains(src, '#')")
    others = abroad.select("src", F.col("symbol").alias("dst"), F.when(F.col("how") == "calls", "CALLS").otherwise("DEPENDS_ON").alias("rel"), F.lit(5).alias("pass"))
    return between.union(parents).union(others).distinct()
