"""Every query of the engine against its SQL, and graph, Cypher, search and store fixtures."""

import os

import duckdb
import pytest

from depweave import queries as engine
from depweave.functions import embedding, paths
from depweave.operators import graph, search, traverse
from depweave.plans import cypher
from depweave.sources.store import GraphStore

SF = "/root/testdata/sf0.001"
BLAST = [("A", "B"), ("B", "C"), ("A", "D"), ("E", "B")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def rows(cols, values):
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return sorted(repr([row[i] for i in order]) for row in values)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = engine.queries()[name](spark, SF)
    want = duck.sql(engine.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "DEPENDS_ON") for a, b in pairs], "src string, dst string, rel string")


@pytest.mark.parametrize(("changed", "depth", "want"), [(["B"], 10, {"A": 1, "E": 1}), (["C"], 10, {"B": 1, "A": 2, "E": 2}), (["A"], 10, {}), (["C"], 1, {"B": 1}), (["X"], 10, {}), ([], 10, {})])
def test_blast_radius(spark, changed, depth, want):
    assert {r["node"]: r["depth"] for r in traverse.blast_radius(edges(spark, BLAST), changed, depth).collect()} == want


def test_cycle_brings_the_start_back(spark):
    cyclic = edges(spark, [*BLAST, ("C", "A")])
    assert {r["node"] for r in traverse.k_hop(cyclic, "A", 3).collect()} == {"A", "B", "C", "D"}
    assert "A" not in {r["node"] for r in traverse.blast_radius(cyclic, ["A"]).collect()}


def cypher_graph(spark):
    nodes = spark.createDataFrame([(n, "File", "file", l) for n, l in [("auth.py", "python"), ("utils.py", "python"), ("models.py", "python"), ("app.rb", "ruby")]], "node_id string, label string, kind string, language string")
    return nodes, edges(spark, [("auth.py", "utils.py"), ("auth.py", "models.py"), ("app.rb", "auth.py")])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (n) RETURN n.path AS p", {"auth.py", "utils.py", "models.py", "app.rb"}),
        ('MATCH (n {path: "auth.py"}) RETURN n.path AS p', {"auth.py"}),
        ('MATCH (n) WHERE n.path ENDS WITH ".rb" RETURN n.path AS p', {"app.rb"}),
        ('MATCH (n {path:"auth.py"})-[:DEPENDS_ON*1..1]->(dep) RETURN dep.path AS p', {"utils.py", "models.py"}),
        ('MATCH (n {path:"app.rb"})-[r:CodeRelation {type:"DEPENDS_ON"}*1..2]->(dep) RETURN dep.path AS p', {"auth.py", "utils.py", "models.py"}),
        ('MATCH (n {path:"utils.py"})<-[:DEPENDS_ON*1..1]-(src) RETURN src.path AS p', {"auth.py"}),
    ],
)
def test_cypher(spark, text, want):
    assert {r["p"] for r in cypher.query(*cypher_graph(spark), text).collect()} == want


@pytest.mark.parametrize("text", ["CREATE (n:File {id:'x'})", "MATCH (n) DELETE n", "MATCH (n) SET n.a = 1 RETURN n", "CREATE(n)"])
def test_writing_is_refused(spark, text):
    with pytest.raises(cypher.CypherError):
        cypher.query(*cypher_graph(spark), text)


def test_fusion_and_cosine(spark):
    ranks = lambda ids: spark.createDataFrame([(x, k + 1) for k, x in enumerate(ids)], "id string, rank int")
    order = [r["id"] for r in search.top(search.fused(ranks("abc"), ranks("bad")), 4).collect()]
    assert set(order[:2]) == {"a", "b"}
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "vec_id string, embedding array<float>")
    assert [r["id"] for r in search.top(search.cosine(vectors, [0.0, 1.0]), 2).collect()] == ["b", "a"]
    assert search.cosine(vectors, [0.0, 0.0]).count() == 0


def test_suffix_match(spark):
    refs = spark.createDataFrame([("save",), ("User.save",), ("none",)], "ref string")
    names = spark.createDataFrame([("User.save", "u#1"), ("Post.save", "p#1")], "name string, symbol string")
    assert {r["ref"]: r["symbol"] for r in graph.suffix_match(refs, names).collect()} == {"save": "p#1", "User.save": "u#1"}


def test_store(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    nodes = spark.createDataFrame([("src/a.py", "file"), ("src/b.py", "file"), ("src/a.py#class:X", "class"), ("src/a.py#constant:C", "constant")], "node_id string, kind string")
    links = spark.createDataFrame([("src/a.py", "src/b.py", "DEPENDS_ON"), ("src/a.py", "src/a.py#class:X", "CONTAINS"), ("src/a.py", "gone.py", "DEPENDS_ON")], "src string, dst string, rel string")
    assert store.load("/repo") is None and store.delete("/repo") is False
    store.save("/repo", nodes, links)
    store.save("/other", nodes.limit(1), links.limit(0))
    stats = {r["root_path"]: (r["nodes"], r["edges"], r["Class"]) for r in store.repos().collect()}
    assert stats == {"/repo": (3, 2, 1), "/other": (1, 0, 0)}
    store.save("/repo", nodes.where("node_id = 'src/b.py'"), links.limit(0))
    assert [r["node_id"] for r in store.load("/repo")[0].collect()] == ["src/b.py"]
    assert store.delete("/repo") and store.load("/repo") is None and store.load("/other") is not None


def test_store_saves_what_it_loaded(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    rows = [("a.py", "file", "x y", 1), ("a.py#function:f", "function", "one", 1), ("a.py#function:f", "function", "two", 2)]
    nodes = spark.createDataFrame(rows, "node_id string, kind string, content string, start_line long")
    store.save("/r", nodes, spark.createDataFrame([("a.py", "a.py#function:f", "CONTAINS"), ("a.py", "a.py#function:f", "CALLS")], "src string, dst string, rel string"))
    store.save("/r", *store.load("/r"))
    got_nodes, got_edges = store.load("/r")
    assert {(r.node_id, r.content, r.start_line) for r in got_nodes.collect()} == {("a.py", "x y", 1), ("a.py#function:f", "one", 1)}  # one whole row of each id
    assert got_edges.count() == 1
    assert {(r.node_id, r.dl) for r in store.read("postings", "/r").where("term = ''").collect()} == {("a.py", 2), ("a.py#function:f", 1)}


def test_store_reads_older_tables(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    old = spark.createDataFrame([("a.py", "File", "file", store.hash("/r"))], "node_id string, label string, kind string, repo_hash string")
    old.write.partitionBy("repo_hash").parquet(f"file://{tmp_path}/store/nodes")
    row = store.read("nodes", "/r").first()
    assert row["node_id"] == "a.py" and row["dsl_macro"] is None and row["scope_refs"] is None


def test_graph_access(spark):
    nodes = chain_graph(spark)[0]
    assert graph.has_node(nodes, "b") and not graph.has_node(nodes, "z")
    assert graph.attributes(nodes, "b") == {"node_id": "b", "label": "Class", "kind": "class", "name": "B", "size": 2} and graph.attributes(nodes, "z") is None


def test_path_functions():
    assert paths.translated("/host/repo/a.py", {"/host": "/mnt", "/host/repo": "/src"}) == "/src/a.py"
    assert paths.translated("/hostile/a", {"/host": "/mnt"}) == "/hostile/a" and paths.translated("/host", {"/host": "/mnt/"}) == "/mnt"


def test_embeddings(spark):
    rows = [("f", "file", "auth", "src/auth.py", "x"), ("m", "method", "login_user", "src/auth.py", "def login_user(): pass"), ("h", "hook", "before", "a.rb", "x")]
    nodes = spark.createDataFrame(rows, "node_id string, kind string, name string, file_path string, content string")
    vectors = embedding.index(nodes)
    assert {r.node_id: len(r.embedding) for r in vectors.collect()} == {"f": embedding.DIMENSIONS, "m": embedding.DIMENSIONS}
    best = search.top(search.cosine(vectors, embedding.vector("login user"), "node_id"), 1).first()
    assert best["id"] == "m" and best["score"] > 0.3
    assert embedding.index(nodes.limit(0)).isEmpty()


def chain_graph(spark):
    nodes = [("a", "File", "file", "A", 1), ("b", "Class", "class", "B", 2), ("c", "Function", "function", "C", 3), ("d", "Function", "function", "D", 4)]
    return spark.createDataFrame(nodes, "node_id string, label string, kind string, name string, size int"), spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "d", "CALLS"), ("d", "b", "CALLS")], "src string, dst string, rel string")


CYPHER = [
    ("MATCH (x)-[]->(y) MATCH (y:Class)-[]->(z) RETURN x.name, z.name", [("A", "C"), ("D", "C")]),
    ("MATCH (x)-[]->(y) MATCH (y {name: 'zzz'}) RETURN x.name", []),
    ("MATCH (x)-[]->(y) MATCH (y {name: 'D'}) RETURN x.name", [("C",)]),
    ("MATCH p = (x {name: 'A'})-[:CALLS*3..3]->(y) RETURN [n IN nodes(p) | n.path] AS p", [(["a", "b", "c", "d"],)]),
    ("MATCH p = (x {name: 'A'})-[:CALLS*2..4]->(y) RETURN [n IN nodes(p) | n.name] AS p, length(p) AS n", [(["A", "B", "C"], 2), (["A", "B", "C", "D"], 3), (["A", "B", "C", "D", "B"], 4)]),
    ("MATCH p = (x {name: 'A'})-[]->(y)-[:CALLS*1..1]->(z) RETURN [n IN nodes(p) | n.size] AS p", [([1, 2, 3],)]),
    ("MATCH (x) WITH collect(x.name) AS l MATCH (y) WHERE y.name IN l RETURN count(*) AS n, size(l) AS s", [(4, 4)]),
    ("MATCH (x) RETURN labels(x) AS l, count(*) AS n", [("Class", 1), ("File", 1), ("Function", 2)]),
    ("RETURN 1 AS one", [(1,)]),
    ("MATCH (x) WHERE x.size > 2 XOR x.name = 'D' RETURN x.size + 10 AS s, x.name + '!' AS t", [(13, "C!")]),
    ("MATCH (x {name: $who}) RETURN x.size AS s", [(2,)]),
    ("MATCH (x {kind: 'function'}) OPTIONAL MATCH (x)-[:CALLS*1..2]->(y:Class) RETURN x.name, y.name", [("C", "B"), ("D", "B")]),
    ("MATCH (x) OPTIONAL MATCH (x)-[]->(y:Function) WHERE y.size > x.size RETURN x.name, y.name", [("A", None), ("B", "C"), ("C", "D"), ("D", None)]),
    ("MATCH (x) WHERE x.name = 'A' OR x.name = 'B' RETURN x.name, size(x.name) AS n ORDER BY x.name DESC", [("A", 1), ("B", 1)]),
]


@pytest.mark.parametrize(("text", "want"), CYPHER)
def test_cypher_semantics(spark, text, want):
    got = cypher.query(*chain_graph(spark), text, {"who": "B"}).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_cypher_refuses(spark):
    for text in ("MATCH (x) SET x.name = 1 RETURN x", "MATCH (x {name: $nobody}) RETURN x", "CREATE (x)", "MATCH (x) RETURN"):
        with pytest.raises(cypher.CypherError):
            cypher.query(*chain_graph(spark), text)
