"""The graph, query and search operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .operators import graph, search, traverse
from .plans import cypher
from .sources import repository
from .sources.tables import geo, page_links, part_edges, table

Query = Callable[[SparkSession, str], DataFrame]
SEEDS = [1, 2, 3]
PART = """e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
     WHERE a.l_quantity < 10 AND a.l_partkey <> b.l_partkey)"""
GEO = """nodes AS (SELECT 'region:' || r_regionkey AS node_id, 'File' AS label, 'region' AS kind, r_name AS name, 0.0::DOUBLE AS size FROM region
     UNION ALL SELECT 'nation:' || n_nationkey, 'Class', 'nation', n_name, 0.0 FROM nation
     UNION ALL SELECT 'customer:' || c_custkey, 'Method', 'customer', c_name, c_acctbal FROM customer
     UNION ALL SELECT 'supplier:' || s_suppkey, 'Function', 'supplier', s_name, s_acctbal FROM supplier),
   edges AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'CONTAINS' AS rel FROM nation
     UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS' FROM customer
     UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS' FROM supplier)"""
_out: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _out[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _walk(start: str, step: str, depth: int) -> str:
    return f"WITH RECURSIVE {PART}, w(node, depth) AS (SELECT {start}, 0 UNION SELECT {step}, depth + 1 FROM w JOIN e ON {'e.dst' if step == 'e.src' else 'e.src'} = w.node WHERE depth < {depth})"


@query(f"WITH {PART} SELECT dst FROM e WHERE src = 1")
def g_direct_deps(spark, sf_dir):
    return graph.dependencies(part_edges(spark, sf_dir), 1)


@query(f"WITH {PART} SELECT src FROM e WHERE dst = 1")
def g_direct_dependents(spark, sf_dir):
    return graph.dependents(part_edges(spark, sf_dir), 1)


@query(_walk("1::BIGINT", "e.dst", 3) + " SELECT DISTINCT node FROM w WHERE depth > 0")
def g_khop_deps(spark, sf_dir):
    return traverse.k_hop(part_edges(spark, sf_dir), 1, 3).select("node")


@query(_walk("1::BIGINT", "e.src", 3) + " SELECT DISTINCT node FROM w WHERE depth > 0")
def g_khop_dependents(spark, sf_dir):
    return traverse.k_hop(part_edges(spark, sf_dir), 1, 3, "in").select("node")


BLAST = _walk("unnest([1, 2, 3])::BIGINT", "e.src", 3)


@query(BLAST + " SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node HAVING node NOT IN (1, 2, 3)")
def g_blast_radius(spark, sf_dir):
    return traverse.blast_radius(part_edges(spark, sf_dir), SEEDS, 3)


@query(BLAST + ", b AS (SELECT node, min(depth) AS depth FROM w GROUP BY node HAVING node NOT IN (1, 2, 3)) SELECT CAST(depth AS INT) AS depth, count(*) AS n FROM b GROUP BY depth")
def g_blast_summary(spark, sf_dir):
    return graph.histogram(traverse.blast_radius(part_edges(spark, sf_dir), SEEDS, 3), "depth")


@query(_walk("1::BIGINT", "e.dst", 3) + " SELECT node FROM w WHERE depth > 0 AND node <> 1 GROUP BY node HAVING min(depth) BETWEEN 2 AND 3")
def g_varlength_2_3(spark, sf_dir):
    return traverse.variable_length(part_edges(spark, sf_dir), 1, 2, 3).select("node")


@query(f"WITH RECURSIVE {PART}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT u.dst, depth + 1 FROM w JOIN u ON u.src = w.node WHERE depth < 2) SELECT DISTINCT node FROM w WHERE depth > 0")
def g_undirected_2hop(spark, sf_dir):
    return traverse.k_hop(part_edges(spark, sf_dir), 1, 2, "both").select("node")


@query(f"WITH {PART} SELECT src, dst FROM e WHERE src <= 100 AND dst <= 100")
def g_subgraph(spark, sf_dir):
    return graph.induced(part_edges(spark, sf_dir), table(spark, sf_dir, "part").where("p_partkey <= 100").select(F.col("p_partkey").alias("node_id")))


@query("SELECT range AS node_id FROM range(0, 30000, 7) WHERE range NOT IN (SELECT p_partkey FROM part)")
def g_missing_paths(spark, sf_dir):
    return graph.missing(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id")), spark.range(0, 30000, 7).withColumnRenamed("id", "node_id"))


@query(f"""WITH {GEO}, k AS (SELECT node_id, kind IN ('region', 'nation') AS file FROM nodes), t AS (SELECT node_id FROM k ORDER BY CASE WHEN file THEN 0 ELSE 1 END, node_id LIMIT 500)
   SELECT src, dst FROM edges WHERE src IN (SELECT node_id FROM t) AND dst IN (SELECT node_id FROM t)""")
def g_truncated_edges(spark, sf_dir):
    """Regions and nations stand for files."""
    nodes, edges = geo(spark, sf_dir)
    nodes = nodes.withColumn("kind", F.when(F.col("kind").isin("region", "nation"), "file").otherwise(F.col("kind")))
    return graph.induced(edges.select("src", "dst"), graph.truncated(nodes, 500))


@query(f"WITH {PART} SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def g_degree(spark, sf_dir):
    return graph.degrees(part_edges(spark, sf_dir))


@query("SELECT l_partkey AS src, l_suppkey AS dst, max(struct_pack(l := l_linenumber, o := l_orderkey)).o AS rel FROM lineitem GROUP BY 1, 2")
def g_edge_dedup_last(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").alias("rel"), F.col("l_linenumber").alias("pass_no"))
    return graph.last_write(edges, [F.col("pass_no").alias("p")]).select("src", "dst", "rel")


@query(f"WITH {GEO} SELECT dst AS node, min(src) AS owner FROM edges JOIN nodes ON node_id = src WHERE kind = 'nation' GROUP BY dst")
def g_enclosing(spark, sf_dir):
    nodes, edges = geo(spark, sf_dir)
    return graph.enclosing(edges, ["nation"], nodes)


PAIRS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in graph.LABEL_PAIRS)


@query(f"WITH {GEO} SELECT src, dst, rel FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE (a.label, b.label) IN ({PAIRS_SQL})")
def g_label_pair_filter(spark, sf_dir):
    nodes, edges = geo(spark, sf_dir)
    return graph.allowed(edges, nodes)


@query(f"""WITH {PART}, s AS (SELECT p_partkey AS file, p_brand AS name, p_partkey AS symbol FROM part),
   h AS (SELECT src, dst AS file, 1 AS hop FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src), m AS (SELECT src, file, min(hop) AS hop FROM h WHERE src <> file GROUP BY 1, 2)
   SELECT src, name, symbol FROM m JOIN s USING (file) QUALIFY row_number() OVER (PARTITION BY src, name ORDER BY hop, file, symbol) = 1""")
def g_imported_closure2(spark, sf_dir):
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("symbol"))
    return graph.imported_symbols(part_edges(spark, sf_dir), symbols)


@query(f"""WITH {GEO} SELECT 'geo' AS repo, count(*) FILTER (label = 'File') AS "File", count(*) FILTER (label = 'Function') AS "Function", count(*) FILTER (label = 'Class') AS "Class", count(*) FILTER (label = 'Method') AS "Method", count(*) AS nodes, (SELECT count(*) FROM edges) AS edges FROM nodes""")
def g_repo_stats(spark, sf_dir):
    nodes, edges = geo(spark, sf_dir)
    return graph.repo_stats(nodes.withColumn("repo", F.lit("geo")), edges.withColumn("repo", F.lit("geo")))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def g_language_hist(spark, sf_dir):
    return graph.histogram(table(spark, sf_dir, "documents"), "lang")


# Cypher.
CYPHER = {
    "c_match_prop": ("MATCH (a {name: 'ASIA'})-[r:CONTAINS]->(b:nation) RETURN b.node_id AS id, b.name AS name, r.type AS type", "SELECT b.node_id AS id, b.name, rel AS type FROM nodes a JOIN edges ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.name = 'ASIA' AND b.kind = 'nation'"),
    "c_where_contains": ("MATCH (n) WHERE n.name CONTAINS 'A' RETURN n.node_id AS id", "SELECT node_id AS id FROM nodes WHERE contains(name, 'A')"),
    "c_where_starts": ("MATCH (n:Class) WHERE n.name STARTS WITH 'NATION_1' RETURN n.name AS name", "SELECT name FROM nodes WHERE label = 'Class' AND starts_with(name, 'NATION_1')"),
    "c_where_ends": ("MATCH (n) WHERE n.path ENDS WITH '7' RETURN n.path AS id", "SELECT node_id AS id FROM nodes WHERE ends_with(node_id, '7')"),
    "c_where_or_in": ("MATCH (n) WHERE n.kind IN ['region', 'nation'] AND (n.name = 'ASIA' OR NOT n.name CONTAINS 'A') RETURN n.name AS name", "SELECT name FROM nodes WHERE kind IN ('region', 'nation') AND (name = 'ASIA' OR NOT contains(name, 'A'))"),
    "c_return_alias_order_limit": ("MATCH (n:customer) RETURN n.node_id AS id, n.size AS size ORDER BY size DESC, id LIMIT 20", "SELECT node_id AS id, size FROM nodes WHERE kind = 'customer' ORDER BY size DESC, id LIMIT 20"),
    "c_skip_limit": ("MATCH (n:customer) RETURN n.node_id AS id ORDER BY id SKIP 10 LIMIT 15", "SELECT node_id AS id FROM nodes WHERE kind = 'customer' ORDER BY id LIMIT 15 OFFSET 10"),
    "c_optional_match": ("MATCH (n) WHERE n.kind <> 'supplier' OPTIONAL MATCH (n)-[:CONTAINS]->(m:supplier) RETURN n.node_id AS a, m.node_id AS b", "SELECT n.node_id AS a, m.node_id AS b FROM nodes n LEFT JOIN (SELECT src, node_id FROM edges JOIN nodes ON dst = node_id WHERE kind = 'supplier') m ON m.src = n.node_id WHERE n.kind <> 'supplier'"),
    "c_union_all": ("MATCH (n:region) RETURN n.kind AS k UNION ALL MATCH (n:nation) RETURN n.kind AS k", "SELECT kind AS k FROM nodes WHERE kind IN ('region', 'nation')"),
    "c_union": ("MATCH (n:region) RETURN n.kind AS k UNION MATCH (n:nation) RETURN n.kind AS k", "SELECT DISTINCT kind AS k FROM nodes WHERE kind IN ('region', 'nation')"),
    "c_with_having": ("MATCH (a:nation)-[:CONTAINS]->(b:customer) WITH a.name AS name, count(*) AS n WHERE n > 3 RETURN name, n", "SELECT a.name, count(*) AS n FROM nodes a JOIN edges ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.kind = 'nation' AND b.kind = 'customer' GROUP BY a.node_id, a.name HAVING count(*) > 3"),
    "c_count_distinct": ("MATCH (a)-[]->(b) RETURN a.kind AS kind, count(DISTINCT b.kind) AS kinds, count(b) AS n, min(b.size) AS lo, max(b.size) AS hi", "SELECT a.kind, count(DISTINCT b.kind) AS kinds, count(*) AS n, min(b.size) AS lo, max(b.size) AS hi FROM nodes a JOIN edges ON a.node_id = src JOIN nodes b ON b.node_id = dst GROUP BY a.kind"),
    "c_chain_2rel": ("MATCH (a:region)-[:CONTAINS]->(b)-[:CONTAINS]->(c:supplier) RETURN a.name AS a, b.name AS b, c.name AS c", "SELECT a.name AS a, b.name AS b, c.name AS c FROM nodes a JOIN edges e ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst JOIN edges f ON f.src = b.node_id JOIN nodes c ON c.node_id = f.dst WHERE a.kind = 'region' AND c.kind = 'supplier'"),
    "c_varlength_typed": ("MATCH (a {name: 'EUROPE'})-[:CONTAINS*1..2]->(b) RETURN b.node_id AS id", "SELECT dst AS id FROM edges JOIN nodes ON node_id = src WHERE name = 'EUROPE' UNION SELECT f.dst FROM edges e JOIN nodes ON node_id = e.src JOIN edges f ON f.src = e.dst WHERE name = 'EUROPE'"),
    "c_reverse": ("MATCH (b:supplier)<-[:CONTAINS]-(a) RETURN a.name AS a, b.name AS b", "SELECT a.name AS a, b.name AS b FROM nodes a JOIN edges ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE b.kind = 'supplier'"),
    "c_bound_label": ("MATCH (x)-[]->(y) MATCH (y:nation)-[]->(z:supplier {kind: 'supplier'}) RETURN x.name AS x, y.name AS y, z.name AS z", "SELECT x.name AS x, y.name AS y, z.name AS z FROM nodes x JOIN edges e ON x.node_id = e.src JOIN nodes y ON y.node_id = e.dst JOIN edges f ON y.node_id = f.src JOIN nodes z ON z.node_id = f.dst WHERE y.kind = 'nation' AND z.kind = 'supplier'"),
    "c_in_variable": ("MATCH (a:region)-[]->(b) WITH a.name AS name, collect(b.node_id) AS ids MATCH (c:nation) WHERE c.node_id IN ids RETURN name, c.name AS nation, size(ids) AS n", "SELECT a.name, c.name AS nation, CAST(count(*) OVER (PARTITION BY a.name) AS INT) AS n FROM nodes a JOIN edges ON a.node_id = src JOIN nodes c ON c.node_id = dst WHERE a.kind = 'region'"),
    "c_xor_arithmetic": ("MATCH (n:customer) WHERE n.size > 5000 XOR n.name ENDS WITH '7' RETURN n.node_id AS id, n.size * 2 + 1 AS twice", "SELECT node_id AS id, size * 2 + 1 AS twice FROM nodes WHERE kind = 'customer' AND (size > 5000) <> ends_with(name, '7')"),
    "c_unwind": ("UNWIND [1, 2, 3] AS x RETURN x", "SELECT CAST(unnest([1, 2, 3]) AS INT) AS x"),
}


def _cypher(text: str) -> Query:
    def run(spark, sf_dir):
        return cypher.query(*geo(spark, sf_dir), text)

    return run


for _name, (_text, _equal) in CYPHER.items():
    _out[_name], _sql[_name] = _cypher(_text), f"WITH {GEO} {_equal}"


@query(f"""WITH {GEO} SELECT a.name || '>' || b.name AS chain FROM nodes a JOIN edges ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.kind = 'region'
   UNION ALL SELECT a.name || '>' || b.name || '>' || c.name FROM nodes a JOIN edges e ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst JOIN edges f ON b.node_id = f.src JOIN nodes c ON c.node_id = f.dst WHERE a.kind = 'region'""")
def c_path_names(spark, sf_dir):
    rows = cypher.query(*geo(spark, sf_dir), "MATCH p = (a:region)-[:CONTAINS*1..2]->(b) RETURN [n IN nodes(p) | n.name] AS names")
    return rows.select(F.array_join("names", ">").alias("chain"))


@query(f"WITH {GEO} SELECT a.name AS name, string_agg(b.name, ',' ORDER BY b.name) AS names FROM nodes a JOIN edges ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.kind = 'region' GROUP BY a.name")
def c_collect(spark, sf_dir):
    rows = cypher.query(*geo(spark, sf_dir), "MATCH (a:region)-[]->(b) RETURN a.name AS name, collect(b.name) AS names")
    return rows.select("name", F.array_join("names", ",").alias("names"))


# Search.
TERMS = "the licensed version"


def _bm25_sql(where: str = "") -> str:
    each = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(sorted(TERMS.split())))
    n = len(TERMS.split())
    score = " + ".join(f"ln((n - df{k} + 0.5) / (df{k} + 0.5) + 1) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avg_dl))" for k in range(n))
    stats = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(n))
    return f"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents {where}),
    c AS (SELECT doc_id AS id, len(t) AS dl, {each} FROM t), s AS (SELECT count(*) AS n, avg(dl) AS avg_dl, {stats} FROM c),
    bm AS (SELECT id, CAST({score} AS DOUBLE) AS score FROM c, s WHERE {' OR '.join(f'tf{k} > 0' for k in range(n))})"""


@query(f"WITH {_bm25_sql()} SELECT id, round(score, 6) AS score FROM bm")
def s_bm25_docs(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), TERMS, "doc_id", "text").select("id", F.round("score", 6).alias("score"))


def _rank(of: str, n: int) -> str:
    return f"(SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {of} ORDER BY rank LIMIT {n})"


@query(f"WITH {_bm25_sql('WHERE lang = ' + chr(39) + 'en' + chr(39))} SELECT id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM {_rank('bm', 20)}")
def s_bm25_kind(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return search.top(search.bm25(docs, TERMS, "doc_id", "text"), 20).select("id", F.round("score", 6).alias("score"), "rank")


COSINE = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), co AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q)"


def _vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


@query(f"WITH {COSINE} SELECT id, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM {_rank('co', 20)}")
def s_cosine_topk(spark, sf_dir):
    return search.top(search.cosine(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)), 20).select("id", F.round("score", 5).alias("score"), "rank")


FUSED = f"f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT id, rank FROM {_rank('bm', 60)} UNION ALL SELECT id, rank FROM {_rank('co', 60)}) GROUP BY id)"


@query(f"WITH {_bm25_sql()}, {COSINE}, {FUSED} SELECT id, round(score, 8) AS score FROM f")
def s_rrf(spark, sf_dir):
    first = search.top(search.bm25(table(spark, sf_dir, "documents"), TERMS, "doc_id", "text"), search.overfetch(20))
    second = search.top(search.cosine(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)), search.overfetch(20))
    return search.fused(first, second).select("id", F.round("score", 8).alias("score"))


@query(f"WITH {_bm25_sql()}, {COSINE}, {FUSED} SELECT id, round(score, 8) AS score, CAST(rank AS INT) AS rank FROM {_rank('f', 20)}")
def s_hybrid(spark, sf_dir):
    return search.hybrid(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), TERMS, _vector(spark, sf_dir)).select("id", F.round("score", 8).alias("score"), "rank")


# Names and paths.
@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def i_href_edges(spark, sf_dir):
    return page_links(spark, sf_dir)


@query("SELECT url, string_split(url, '/')[-1] AS base, substr(sha256(url), 1, 16) AS repo_hash FROM pages")
def i_path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", paths.basename(F.col("url")).alias("base"), paths.repo_hash(F.col("url")).alias("repo_hash"))


@query("SELECT DISTINCT l_orderkey AS ref, coalesce(a.p_partkey, b.p_partkey) AS target FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN part a ON a.p_partkey = l_orderkey * 2 LEFT JOIN part b ON b.p_partkey = l_orderkey WHERE coalesce(a.p_partkey, b.p_partkey) IS NOT NULL")
def i_candidate_resolution(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref")).distinct().withColumn("candidates", F.array(F.col("ref") * 2, F.col("ref")))
    return graph.resolve(wanted, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target")))


ASSOCIATION = "concat(replace(lower(p_type), ' ', '_'), CASE p_partkey % 5 WHEN 0 THEN 'ies' WHEN 1 THEN 'xes' WHEN 2 THEN '_ids' WHEN 3 THEN 'ss' ELSE 's' END)"


@query(f"""WITH a AS (SELECT p_partkey, {ASSOCIATION} AS name FROM part), b AS (SELECT p_partkey, regexp_replace(name, '_ids?$', '') AS s FROM a),
   c AS (SELECT p_partkey, CASE WHEN s LIKE '%ies' THEN left(s, -3) || 'y' WHEN regexp_matches(s, '[sxz]es$') THEN left(s, -2) WHEN s LIKE '%s' AND NOT s LIKE '%ss' THEN left(s, -1) ELSE s END AS s FROM b)
   SELECT p_partkey AS id, array_to_string(list_transform(string_split(s, '_'), lambda w: upper(w[1]) || lower(w[2:])), '') AS constant FROM c""")
def i_assoc_to_const(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), paths.constant_name(F.expr(ASSOCIATION)).alias("constant"))


@query("""WITH n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_type || '.' || p_brand ELSE p_brand END AS name, p_partkey AS symbol FROM part), r AS (SELECT p_brand AS ref FROM part UNION SELECT p_type || '.' || p_brand FROM part),
   e AS (SELECT name AS ref, min(symbol) AS symbol FROM n GROUP BY name), t AS (SELECT string_split(name, '.')[-1] AS ref, min(symbol) AS symbol FROM n WHERE contains(name, '.') GROUP BY 1)
   SELECT ref, coalesce(e.symbol, t.symbol) AS symbol FROM r LEFT JOIN e USING (ref) LEFT JOIN t USING (ref) WHERE coalesce(e.symbol, t.symbol) IS NOT NULL""")
def i_suffix_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    dotted = F.concat_ws(".", "p_type", "p_brand")
    names = part.select(F.when(F.col("p_partkey") % 2 == 0, dotted).otherwise(F.col("p_brand")).alias("name"), F.col("p_partkey").alias("symbol"))
    return graph.suffix_match(part.select(F.col("p_brand").alias("ref")).union(part.select(dotted.alias("ref"))).distinct(), names)


#: Source files of which the indexer's results are known.
FILES = {
    "app/main.py": ("python", "import os\n\nclass Main:\n    def run(self):\n        pass\n\ndef go():\n    Main()\n"),
    "web/user.ts": ("typescript", "export class User {\n  load(id: string): Profile { return get(id) }\n}\nfunction get(id) { return new Cache() }\nconst f = function no() {}\n"),
    "rb/post.rb": ("ruby", "module Blog\n  class Post < Base\n    include Searchable\n    has_many :comments\n    before_save :slug\n    enum status: [:draft]\n    def save\n      Audit.log\n    end\n    def self.build = new\n  end\nend\n"),
    "db/schema.sql": ("sql", 'CREATE TABLE "public"."users" (\n  id INT PRIMARY KEY,\n  name VARCHAR(20),\n  PRIMARY KEY (id)\n);\nCREATE TABLE posts (\n  id int,\n  FOREIGN KEY (id) REFERENCES users (id)\n);\n'),
}


def _parsed(spark, kinds: str) -> DataFrame:
    sources = spark.createDataFrame([(f, *x) for f, x in FILES.items()], "file string, language string, content string")
    return repository.parsed(sources).where(f"fact = 'node' and {kinds}")


def _values(columns: str, *rows: tuple) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(r).replace('None', 'NULL') for r in rows)}) AS t({columns})"


@query(_values("node_id, kind, name, start_line", ("app/main.py#class:Main", "class", "Main", 3), ("app/main.py#method:Main.run", "method", "run", 4), ("app/main.py#function:go", "function", "go", 7)))
def i_python_symbols(spark, sf_dir):
    return _parsed(spark, "file like '%.py'").select("node_id", "kind", "name", F.col("start_line").cast("int").alias("start_line"))


@query(_values("node_id, kind, is_exported, refs", ("web/user.ts#class:User", "class", True, ""), ("web/user.ts#method:User.load", "method", False, "Profile"), ("web/user.ts#function:get", "function", False, "Cache")))
def i_ts_symbols(spark, sf_dir):
    return _parsed(spark, "file like '%.ts'").select("node_id", "kind", "is_exported", F.concat_ws(",", paths.distinct_refs(F.col("scope_refs"))).alias("refs"))


@query(_values("node_id, kind, owner_name, refs", ("rb/post.rb#module:Blog", "module", None, ""), ("rb/post.rb#class:Blog::Post", "class", None, ""), ("rb/post.rb#method:Blog::Post.save", "method", "Blog::Post", "Audit"), ("rb/post.rb#method:Blog::Post.build", "class_method", "Blog::Post", "")))
def i_ruby_symbols(spark, sf_dir):
    return _parsed(spark, "file like '%.rb' and dsl_macro is null").select("node_id", "kind", "owner_name", F.concat_ws(",", paths.distinct_refs(F.col("scope_refs"))).alias("refs"))


@query(_values("node_id, kind, macro", ("rb/post.rb#mixin:include:Searchable", "mixin", "include"), ("rb/post.rb#association:has_many:comments", "association", "has_many"), ("rb/post.rb#hook:before_save:slug", "hook", "before_save"), ("rb/post.rb#enum:status", "enum", "enum")))
def i_ruby_dsl(spark, sf_dir):
    return _parsed(spark, "dsl_macro is not null").select("node_id", "kind", F.col("dsl_macro").alias("macro"))


@query(_values("node_id, columns", ("db/schema.sql#db_table:users", "id int, name varchar(20)"), ("db/schema.sql#db_table:posts", "id int")))
def i_sql_columns(spark, sf_dir):
    return _parsed(spark, "kind = 'db_table'").select("node_id", F.col("content").alias("columns"))


@query(f"WITH {_bm25_sql()} SELECT id, CAST(rank AS INT) AS rank FROM {_rank('bm', 60)}")
def s_bm25_rank(spark, sf_dir):
    return search.top(search.bm25(table(spark, sf_dir, "documents"), TERMS, "doc_id", "text"), search.overfetch(20)).select("id", "rank")


@query("SELECT CAST(range AS INT) AS n, CAST(greatest(3 * range, 50) AS INT) AS fetched FROM range(1, 41)")
def s_overfetch(spark, sf_dir):
    return spark.createDataFrame([(n, search.overfetch(n)) for n in range(1, 41)], "n int, fetched int")


def queries() -> dict[str, Query]:
    return dict(_out)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
