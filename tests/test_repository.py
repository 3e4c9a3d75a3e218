"""Indexing a folder of sources, and the tools over it."""

import pytest

from depweave.sources import graph_json, parsers, repository
from depweave.tools import Tools

SOURCES = {
    "app/main.py": "import lib.util\nfrom . import x\nfrom .models import User\nimport lib.other as o\n\nclass Main:\n    def run(self):\n        helper()\n\nif True:\n    def go():\n        User()\n        def hidden(): pass\n",
    "app/__init__.py": "",
    "app/models.py": "from lib.util import helper\n\nclass User:\n    class Meta:\n        def deep(self): pass\n",
    "src/lib/util.py": "def helper():\n    return 1\n",
    "src/lib/other.py": "",
    "web/index.ts": "// import x from './no'\nimport {a} from './user.service'\nexport * from './parts';\nconst s = \"import './no'\"; const q = require('../web/plain')\nimport 'react'\n",
    "web/no.ts": "",
    "web/user.service.ts": "",
    "web/parts/index.ts": "",
    "web/plain.js": "",
    "rb/a.rb": "require_relative 'b'\nrequire 'rb/c'\n# require 'rb/d'\nautoload :D, 'rb/d'\n",
    "rb/b.rb": "", "rb/c.rb": "", "rb/d.rb": "",
    "db/schema.sql": 'CREATE TABLE "public"."users" (\n  id INT PRIMARY KEY,\n  name VARCHAR(20),\n  PRIMARY KEY (id)\n);\nCREATE TABLE posts (\n  id int,\n  FOREIGN KEY (id) REFERENCES public.users (id)\n);\nALTER TABLE ONLY users ADD CONSTRAINT c FOREIGN KEY (id) REFERENCES posts (id);\n',
    "broken.py": "def (:\n",
    "node_modules/x.js": "", "notes.txt": "import x",
}
IMPORTS = {("app/main.py", "src/lib/util.py"), ("app/main.py", "app/__init__.py"), ("app/main.py", "app/models.py"), ("app/models.py", "src/lib/util.py"), ("web/index.ts", "web/user.service.ts"), ("web/index.ts", "web/parts/index.ts"), ("web/index.ts", "web/plain.js"), ("rb/a.rb", "rb/b.rb"), ("rb/a.rb", "rb/c.rb"), ("rb/a.rb", "rb/d.rb")}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repo")
    for name, text in SOURCES.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


def test_imports(spark, root):
    nodes, edges = repository.index(spark, root)
    assert {(r.src, r.dst) for r in edges.collect()} == IMPORTS
    assert {r.node_id for r in nodes.collect()} == set(SOURCES) - {"node_modules/x.js", "notes.txt"}


def test_symbols(spark, root):
    nodes, edges = repository.index(spark, root, ["python", "sql"], symbols=True)
    names = {r.node_id: r for r in nodes.where("kind <> 'file'").collect()}
    assert set(names) == {"app/main.py#class:Main", "app/main.py#method:Main.run", "app/main.py#function:go", "app/models.py#class:User", "app/models.py#class:Meta", "app/models.py#method:Meta.deep", "src/lib/util.py#function:helper", "db/schema.sql#db_table:users", "db/schema.sql#db_table:posts"}
    assert names["db/schema.sql#db_table:users"].content == "id int, name varchar(20)"
    assert names["src/lib/util.py#function:helper"].content == "def helper():\n    return 1" and names["app/main.py#method:Main.run"].owner_name == "Main"
    got = {(r.src, r.dst): r.rel for r in edges.collect()}
    assert got["app/main.py#function:go", "app/models.py#class:User"] == "CALLS"
    assert got["db/schema.sql#db_table:posts", "db/schema.sql#db_table:users"] == got["db/schema.sql#db_table:users", "db/schema.sql#db_table:posts"] == "DEPENDS_ON"
    assert got["app/models.py#class:User", "app/models.py#class:Meta"] == "CONTAINS" and sum(r == "CALLS" for r in got.values()) == 1


def test_parser_keeps_the_file_it_cannot_read():
    assert [f["fact"] for f in parsers.facts("a.py", "python", b"def (:\xff", True)] == ["file"]


RAILS = {
    "app/course.rb": "class Course < Base\n  include Publishable\n  belongs_to :school\n  rescue_from Oops, with: :h\n  def teach\n    Teacher.find(1)\n    assist\n  end\n  def assist; end\nend\n",
    "app/base.rb": "class Base\nend\n", "app/school.rb": "class School < Unknown::Thing\n  has_one :course\nend\n", "app/publishable.rb": "module Publishable\n  extend ActiveSupport::Concern\n  def publish; end\nend\n",
    "app/teacher.rb": "class Teacher\n  def self.find(x) = x\nend\n", "app/oops.rb": "class Oops < StandardError\nend\n",
    "web/a.ts": "import {b} from './b'\nexport function a() { b(); x.helper(); const s: Service = 1 }\n", "web/b.ts": "export function b() {}\nexport function helper() {}\n", "web/service.ts": "export class Service { go() { return new Other() } }\n", "web/other.js": "class Other {}\n",
}


def test_names_across_files(spark, tmp_path):
    for name, text in RAILS.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    nodes, edges = repository.index(spark, str(tmp_path), symbols=True)
    got = {(r.src, r.dst): r.rel for r in edges.where("rel <> 'CONTAINS'").collect()}
    course = "app/course.rb#class:Course"
    files = {("app/course.rb", f"app/{x}.rb") for x in ("base", "school", "publishable", "teacher", "oops")} | {("app/school.rb", "app/course.rb"), ("web/a.ts", "web/b.ts"), ("web/a.ts", "web/service.ts"), ("web/service.ts", "web/other.js")}
    assert {k for k in got if "#" not in k[0]} == files and all(got[k] == "DEPENDS_ON" for k in files)
    assert {k: v for k, v in got.items() if "#" in k[0]} == {
        (course, "app/base.rb#class:Base"): "INHERITS", (course, "app/publishable.rb#module:Publishable"): "DEPENDS_ON", (course, "app/school.rb#class:School"): "DEPENDS_ON", (course, "app/oops.rb#class:Oops"): "DEPENDS_ON",
        ("app/school.rb#class:School", course): "DEPENDS_ON", ("app/course.rb#method:Course.teach", "app/teacher.rb#class:Teacher"): "CALLS", ("app/course.rb#method:Course.teach", "app/teacher.rb#method:Teacher.find"): "CALLS",
        ("app/course.rb#method:Course.teach", "app/course.rb#method:Course.assist"): "CALLS", ("web/a.ts#function:a", "web/b.ts#function:b"): "CALLS", ("web/a.ts#function:a", "web/b.ts#function:helper"): "CALLS",
        ("web/a.ts#function:a", "web/service.ts#class:Service"): "CALLS", ("web/service.ts#method:Service.go", "web/other.js#class:Other"): "CALLS",
    }
    kinds = {r.node_id: (r.kind, r.language) for r in nodes.collect()}
    assert kinds["app/publishable.rb#module:Publishable"] == ("concern", "ruby") and kinds["web/other.js#class:Other"] == ("class", "typescript")


RUBY = r"""module Admin
  class User::Role < Base
    after_create do
      has_one :hidden
    end
    scope :live, -> { where(x: 1) }
    LIMIT = %w[class end]
    Point = Struct.new(:x, :y) do
      def inside; end
    end
    class << self
      def one = 1
    end
    private def two(a)
      "#{Three.call}" if a / 2 > 1
      x = if a then 1 else 2 end
      y = <<~SQL
        class Fake
      SQL
      /def end/ =~ x
      # class Comment
    end
    alias old new_one
    delegate :a, to: :b
    def after?; :end; end
  end
end
Admin.class_eval do
  def late
    two
  end
end
"""


def test_ruby_scanner():
    found = {f["node_id"].removeprefix("m.rb#"): f for f in parsers.facts("m.rb", "ruby", RUBY.encode(), True) if f["fact"] == "node"}
    assert set(found) == {
        "module:Admin", "class:Admin::User::Role", "hook:after_create:__block__", "scope:live", "constant:Admin::User::Role::LIMIT", "struct:Admin::User::Role::Point", "method:Admin::User::Role.one", "method:Admin::User::Role.two",
        "alias:old", "delegate:a", "method:Admin::User::Role.after?", "method:Admin.late",
    }
    assert found["method:Admin::User::Role.one"]["kind"] == "class_method" and found["method:Admin::User::Role.two"]["scope_refs"] == ["Three"]
    assert (found["class:Admin::User::Role"]["start_line"], found["class:Admin::User::Role"]["end_line"]) == (2, 26) and found["method:Admin.late"]["owner_name"] == "Admin"
    assert [parsers.ruby.constant_name(x) for x in ("schools", "enrollments", "course_sections", "school_id", "categories", "boxes", "class")] == ["School", "Enrollment", "CourseSection", "School", "Category", "Box", "Class"]


def test_tools(spark, root, tmp_path):
    tools = Tools(spark, str(tmp_path / "graphs"))
    assert tools.call("nothing")["code"] == "UNKNOWN_TOOL" and tools.call("search", {"root_path": root})["code"] == "MISSING_PARAM"
    assert tools.call("blast_radius", {"root_path": root, "changed_files": []})["code"] == "REPO_NOT_FOUND"
    assert tools.call("index_repo", {"root_path": f"{root}/none"})["code"] == "NOT_FOUND"
    assert tools.call("index_repo", {"root_path": root, "with_symbols": True})["status"] == "indexed"
    assert tools.call("index_repo", {"root_path": root})["status"] == "already_indexed"
    assert tools.call("get_dependencies", {"root_path": root, "file_path": "rb/a.rb"})["dependencies"] == ["rb/b.rb", "rb/c.rb", "rb/d.rb"]
    assert tools.call("get_dependents", {"root_path": root, "file_path": "src/lib/util.py"})["dependents"] == ["app/main.py", "app/models.py"]
    assert tools.call("get_dependents", {"root_path": root, "file_path": "x"})["code"] == "NOT_FOUND"
    assert tools.call("blast_radius", {"root_path": root, "changed_files": ["rb/d.rb"]}) == {"changed": ["rb/d.rb"], "affected": ["rb/a.rb"], "depth_map": {"rb/a.rb": 1}, "total": 1}
    assert tools.call("search", {"root_path": root, "query": "helper", "kind": "function"})["results"][0]["id"] == "src/lib/util.py#function:helper"
    assert tools.call("query_graph", {"root_path": root, "cypher": "MATCH (n) DELETE n"})["code"] == "QUERY_NOT_ALLOWED"
    assert tools.call("query_graph", {"root_path": root, "cypher": "MATCH (n:Class) RETURN count(*) AS n"})["rows"] == [{"n": 5}]
    part = tools.call("get_graph", {"root_path": root, "max_nodes": 3})
    assert part["truncated"] and len(part["nodes"]) == 3
    assert tools.call("get_graph", {"root_path": root, "subgraph_paths": ["rb/a.rb", "rb/b.rb", "x"]})["missing_paths"] == ["x"]
    assert tools.call("list_repos")["repos"][0]["breakdown"]["Class"] == 5
    assert tools.call("delete_repo", {"root_path": root})["status"] == "deleted" and tools.call("delete_repo", {"root_path": root})["code"] == "NOT_FOUND"


def test_json_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a.py", "python", "file"), ("b.rb", None, None)], "node_id string, language string, kind string")
    edges = spark.createDataFrame([("a.py", "b.rb", "CALLS"), ("b.rb", "a.py", None)], "src string, dst string, rel string")
    graph_json.save(nodes, edges, f"{tmp_path}/g")
    got_nodes, got_edges = graph_json.load(spark, f"{tmp_path}/g")
    assert {tuple(r) for r in got_nodes.collect()} == {("a.py", "a.py", "python", "file"), ("b.rb", "b.rb", "", "file")}
    assert {tuple(r) for r in got_edges.collect()} == {("a.py", "b.rb", "CALLS"), ("b.rb", "a.py", "DEPENDS_ON")}
    graph_json.save(nodes.limit(0), edges.limit(0), f"{tmp_path}/g")
    assert graph_json.load(spark, f"{tmp_path}/g")[0].isEmpty()
