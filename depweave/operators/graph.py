"""Operators on nodes(node_id, ...) and edges(src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of labels between which edges are kept.
LABEL_PAIRS = [("File", "File"), ("File", "Function"), ("File", "Class"), ("File", "Method"), ("Class", "Class"), ("Class", "Method"), ("Class", "Function"), ("Function", "Function"), ("Function", "Class"), ("Function", "Method"), ("Method", "Function"), ("Method", "Class"), ("Method", "Method")]
#: Label by kind; kinds that are not listed are not stored.
LABELS = {
    "file": "File", "function": "Function", "class": "Class", "module": "Class", "concern": "Class", "db_table": "Class", "method": "Method", "class_method": "Method", "hook": "Method", "association": "Method",
    "validation": "Method", "scope": "Method", "mixin": "Method", "attr": "Method", "enum": "Method", "delegate": "Method", "alias": "Method", "helper_method": "Method", "rescue_from": "Method",
}


def has_node(nodes: DataFrame, node) -> bool:
    return not nodes.where(F.col("node_id") == F.lit(node)).isEmpty()


def attributes(nodes: DataFrame, node) -> dict | None:
    """What is known of one node; None if it isn't there."""
    row = nodes.where(F.col("node_id") == F.lit(node)).first()
    return row and {k: v for k, v in row.asDict().items() if v is not None}


def dependencies(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == F.lit(node)).select("dst").distinct()


def dependents(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("dst") == F.lit(node)).select("src").distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(node_id)."""
    ids = nodes.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)


def missing(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Asked-for ids (node_id) that are no nodes."""
    return wanted.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_anti")


def truncated(nodes: DataFrame, max_nodes: int = 500) -> DataFrame:
    """The first max_nodes nodes: files before symbols, then by id."""
    return nodes.orderBy(F.when(F.col("kind") == "file", 0).otherwise(1), "node_id").limit(max_nodes)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in): one pass, each edge counted at both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").cast("long").alias("n_out"), F.sum("e.i").cast("long").alias("n_in"))


def last_write(edges: DataFrame, order: list) -> DataFrame:
    """One edge for each (src, dst): the last in order. A partially aggregated maximum, so a hot pair costs no sort."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    last = edges.groupBy("src", "dst").agg(F.max(F.struct(*order, *rest)).alias("last"))
    return last.select("src", "dst", *[F.col("last").getField(c).alias(c) for c in rest])


def with_label(nodes: DataFrame) -> DataFrame:
    """Nodes of known kind with their label."""
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return nodes.withColumn("label", F.element_at(names, F.col("kind"))).where("label is not null")


def allowed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between existing nodes whose labels form an allowed pair. nodes: node_id, label."""
    ends = [nodes.select(F.col("node_id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("src", "dst")]
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in LABEL_PAIRS])
    both = edges.join(ends[0], "src").join(ends[1], "dst")
    return both.where(F.array_contains(pairs, F.concat_ws(">", "src_label", "dst_label"))).select(*edges.columns)


def enclosing(contains: DataFrame, kinds: list[str], nodes: DataFrame) -> DataFrame:
    """(node, owner): the least container of one of the kinds."""
    owners = nodes.where(F.col("kind").isin(kinds)).select(F.col("node_id").alias("src"))
    return contains.join(owners, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("owner"))


def imported_symbols(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, name, symbol): names that a file sees through its imports up to two hops; nearer files and smaller ids win. symbols: file, name, symbol."""
    one = edges.where("src <> dst").select("src", "dst").distinct()
    near = one.join(symbols, F.col("dst") == F.col("file")).groupBy("src", "name", "file").agg(F.min("symbol").alias("symbol"))
    near = near.groupBy("src", "name").agg(F.slice(F.array_sort(F.collect_list(F.struct("file", "symbol"))), 1, 2).alias("best"))
    # Of what a neighbour sees, two files are enough: one of them may be the file that asks, which doesn't import itself.
    far = one.join(near.withColumnRenamed("src", "dst"), "dst").select("src", "name", F.explode("best").alias("b")).where("b.file <> src")
    both = near.select("src", "name", F.lit(1).alias("hop"), F.col("best")[0].alias("b")).union(far.select("src", "name", F.lit(2).alias("hop"), "b"))
    return both.groupBy("src", "name").agg(F.min(F.struct("hop", "b.file", "b.symbol")).alias("best")).select("src", "name", F.col("best.symbol").alias("symbol"))


def resolve(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(ref, target): the first of each reference's candidates that exists. wanted: ref, candidates (array); known: target."""
    each = wanted.select("ref", F.posexplode("candidates").alias("place", "target"))
    return each.join(known.select("target").distinct(), "target").groupBy("ref").agg(F.min(F.struct("place", "target")).alias("b")).select("ref", F.col("b.target").alias("target"))


def suffix_match(refs: DataFrame, names: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """refs and the `symbol` of the name that equals `ref`, else of one whose last dotted segment it is; refs without any are left out.

    refs: by, ref, ...; names: by, name, symbol. Of several the first by `order` (columns of names), then the least symbol stays, but
    never one that equals a `src` of refs. One equi-join on the name or its last segment does both.
    """
    by, order = by or [], order or []
    key = lambda ref, partly: names.select(*by, ref.alias("ref"), F.struct(F.lit(partly).alias("partly"), *order, "symbol").alias("_best"))
    keys = key(F.col("name"), False).union(key(F.substring_index("name", ".", -1), True).where("name like '%.%'"))
    both = refs.join(keys, [*by, "ref"])
    both = both.where(F.col("_best.symbol") != F.col("src")) if "src" in refs.columns else both
    return both.groupBy(*refs.columns).agg(F.min("_best").alias("_best")).select(*refs.columns, F.col("_best.symbol").alias("symbol"))


def definers(symbols: DataFrame) -> DataFrame:
    """(name, first, first_script, symbol, symbol_file): the first file, and script, in order of paths that defines a name, and the symbol of its last definer. symbols: file, language, place, name, node_id."""
    script = F.when(F.col("language").isin("typescript", "javascript"), F.col("file"))
    found = symbols.groupBy("name").agg(F.min("file").alias("first"), F.min(script).alias("first_script"), F.max(F.struct("file", "place", "node_id")).alias("last"))
    return found.select("name", "first", "first_script", F.col("last.node_id").alias("symbol"), F.col("last.file").alias("symbol_file"))


def repo_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, nodes, edges) and a count per label. nodes: repo, label; edges: repo."""
    labels = ["File", "Function", "Class", "Method"]
    counts = nodes.groupBy("repo").agg(*[F.count_if(F.col("label") == x).alias(x) for x in labels])
    counts = counts.withColumn("nodes", sum((F.col(x) for x in labels[1:]), F.col(labels[0])))
    return counts.join(edges.groupBy("repo").agg(F.count("*").alias("edges")), "repo", "left").na.fill(0, ["edges"])


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def ranked(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in order, numbered from 1; only they are ever sorted in one task."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
