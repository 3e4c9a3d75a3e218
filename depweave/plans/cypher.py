"""Read-only Cypher compiled to DataFrames over nodes(node_id, label, kind, ...) and edges(src, dst, rel).

A node variable is a scan with its label, properties and own conditions pushed in; on a variable that is bound already they are filters.
A fixed relationship is two equi-joins.  One of variable length is a frontier of (start, node) pairs, so each end is one row at its shortest
distance; in a named path it is all walks, one row each, with their nodes.  OPTIONAL MATCH starts from the bound rows only.
The grammar has no clause that writes.  `path` is another name of node_id; $name is a parameter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators._shared import cheap, written

TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+\.\d+|\d+(?!\.\.)|\d+)|(?P<id>[A-Za-z_]\w*)|(?P<param>\$[A-Za-z_]\w*)|(?P<op><>|<=|>=|=~|<-|->|\.\.|[-()\[\]{}:,.*=<>|+/%]))""")
LABELS = ("File", "Function", "Class", "Method")
AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
MOST_HOPS = 10


class CypherError(ValueError):
    """The query isn't in the grammar, or names something unknown."""


class NotReading(CypherError):
    """A clause that isn't one of the reading ones."""


@dataclass
class Node:
    var: str
    label: str | None = None
    props: dict = field(default_factory=dict)


@dataclass
class Rel:
    var: str
    type: str | None
    direction: str
    hops: tuple[int, int] | None


@dataclass
class Match:
    paths: list[tuple[str | None, list]]
    where: tuple | None
    optional: bool


@dataclass
class Projection:
    items: list[tuple[tuple, str]]
    distinct: bool
    order: list[tuple[tuple, bool]]
    skip: int | None
    limit: int | None
    where: tuple | None = None
    final: bool = False


class Parser:
    def __init__(self, text: str, params: dict | None = None) -> None:
        self.params = params or {}
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip().rstrip(";")
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                if not text[at:].strip():
                    break
                raise CypherError(f"unexpected {text[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.fresh = 0, 0

    def peek(self, *words: str) -> bool:
        return all(self.at + k < len(self.tokens) and self.tokens[self.at + k][0] != "str" and self.tokens[self.at + k][1].upper() == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"{word} expected at {self.tokens[self.at : self.at + 3]}")

    def next(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise CypherError(f"{kind} expected at {self.tokens[self.at : self.at + 3]}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        self.fresh += 1
        return f"_v{self.fresh}"

    def query(self) -> tuple[list[list], list[bool]]:
        parts, alls = [self.single()], []
        while self.take("UNION"):
            alls.append(self.take("ALL"))
            parts.append(self.single())
        if self.at < len(self.tokens):
            raise NotReading(f"only reading clauses are allowed; got {self.tokens[self.at][1]}")
        return parts, alls

    def single(self) -> list:
        out: list = []
        while True:
            if self.take("OPTIONAL", "MATCH"):
                out.append(self.match(True))
            elif self.take("MATCH"):
                out.append(self.match(False))
            elif self.take("UNWIND"):
                value = self.expr()
                self.need("AS")
                out.append(("unwind", value, self.next("id")))
            elif self.take("WITH"):
                p = self.projection()
                p.where = self.expr() if self.take("WHERE") else None
                out.append(p)
            elif self.take("RETURN"):
                p = self.projection()
                p.final = True
                return [*out, p]
            else:
                raise NotReading("only MATCH, OPTIONAL MATCH, UNWIND, WITH and RETURN are allowed")

    def match(self, optional: bool) -> Match:
        paths = [self.path()]
        while self.take(","):
            paths.append(self.path())
        return Match(paths, self.expr() if self.take("WHERE") else None, optional)

    def path(self) -> tuple[str | None, list]:
        name = None
        if self.tokens[self.at][0] == "id" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "=":
            name = self.next("id")
            self.need("=")
        parts: list = [self.node()]
        while self.peek("-") or self.peek("<-"):
            parts += [self.rel(), self.node()]
        return name, parts

    def props(self) -> dict:
        out = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.next("id")
                self.need(":")
                out[key] = self.literal()
                self.take(",")
        return out

    def node(self) -> Node:
        self.need("(")
        var = self.next("id") if self.tokens[self.at][0] == "id" else self.name()
        label = self.next("id") if self.take(":") else None
        out = Node(var, label, self.props())
        self.need(")")
        return out

    def hops(self) -> tuple[int, int] | None:
        if not self.take("*"):
            return None
        if self.tokens[self.at][0] != "num" and not self.peek(".."):
            return (1, MOST_HOPS)
        least = int(self.next("num")) if self.tokens[self.at][0] == "num" else 1
        if not self.take(".."):
            return (least, least)
        most = int(self.next("num")) if self.tokens[self.at][0] == "num" else MOST_HOPS
        return (least, MOST_HOPS if most >= 100 else most)

    def rel(self) -> Rel:
        back = self.take("<-")
        if not back:
            self.need("-")
        var, kind, hops = self.name(), None, None
        if self.take("["):
            if self.tokens[self.at][0] == "id":
                var = self.next("id")
            if self.take(":"):
                kind = self.next("id")
            hops = self.hops()
            kind = self.props().get("type", None if kind == "CodeRelation" else kind)
            hops = hops or self.hops()
            self.need("]")
        forward = self.take("->")
        if not forward:
            self.need("-")
        return Rel(var, kind, "in" if back and not forward else "out" if forward and not back else "both", hops)

    def projection(self) -> Projection:
        distinct, items = self.take("DISTINCT"), []
        while True:
            start = self.at
            e = self.expr()
            text = "".join(t for _, t in self.tokens[start : self.at])
            items.append((e, self.next("id") if self.take("AS") else text))
            if not self.take(","):
                break
        order = []
        if self.take("ORDER", "BY"):
            while True:
                e = self.expr()
                down = self.take("DESC") or self.take("DESCENDING")
                if not down:
                    self.take("ASC") or self.take("ASCENDING")
                order.append((e, down))
                if not self.take(","):
                    break
        skip = int(self.next("num")) if self.take("SKIP") else None
        return Projection(items, distinct, order, skip, int(self.next("num")) if self.take("LIMIT") else None)

    def expr(self) -> tuple:
        left = self.exclusive()
        while self.take("OR"):
            left = ("or", left, self.exclusive())
        return left

    def exclusive(self) -> tuple:
        left = self.conjunction()
        while self.take("XOR"):
            left = ("xor", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.negation()
        while self.take("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        for words, op in ((("CONTAINS",), "contains"), (("STARTS", "WITH"), "starts"), (("ENDS", "WITH"), "ends"), (("=~",), "like"), (("<>",), "<>"), (("<=",), "<="), ((">=",), ">="), (("=",), "="), (("<",), "<"), ((">",), ">"), (("IN",), "in")):
            if self.take(*words):
                return (op, left, self.sum())
        if self.take("IS", "NOT", "NULL"):
            return ("not", ("null", left))
        return ("null", left) if self.take("IS", "NULL") else left

    def sum(self) -> tuple:
        left = self.product()
        while self.peek("+") or self.peek("-"):
            left = ("+" if self.take("+") else self.need("-") or "-", left, self.product())
        return left

    def product(self) -> tuple:
        left = self.atom()
        while any(self.peek(x) for x in "*/%"):
            self.at += 1
            left = (self.tokens[self.at - 1][1], left, self.atom())
        return left

    def literal(self):
        if self.at >= len(self.tokens):
            raise CypherError("a value expected at the end")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "param":
            if text[1:] not in self.params:
                raise CypherError(f"no parameter {text}")
            return self.params[text[1:]]
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "num":
            return float(text) if "." in text else int(text)
        if text == "-":
            return -self.literal()
        if text.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()]
        raise CypherError(f"a value expected, not {text}")

    def atom(self) -> tuple:
        if self.take("("):
            out = self.expr()
            self.need(")")
            return out
        if self.take("["):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1].upper() == "IN":  # [v IN nodes(p) | v.prop]
                var = self.next("id")
                self.need("IN")
                of = self.atom()
                self.need("|")
                value = self.expr()
                self.need("]")
                return ("comprehension", var, of, value)
            items = []
            while not self.take("]"):
                items.append(self.literal())
                self.take(",")
            return ("list", items)
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "id" and text.upper() not in ("TRUE", "FALSE", "NULL"):
            self.at += 1
            if self.take("("):
                distinct = self.take("DISTINCT")
                args = [("star",)] if self.take("*") else [self.expr()] if not self.peek(")") else []
                self.need(")")
                return ("call", text.lower(), distinct, args)
            return ("prop", text, self.next("id")) if self.take(".") else ("var", text)
        return ("value", self.literal())


class Compiler:
    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges, self.columns = nodes, edges, nodes.columns
        self.carried = ["node_id"]  # what the nodes of a named path are asked for

    def run(self, text: str, params: dict | None = None) -> DataFrame:
        parts, alls = Parser(text, params).query()
        asked = {m for m in re.findall(r"\|\s*\w+\.(\w+)", text) if m in self.columns}
        self.carried = ["node_id", *sorted(asked - {"node_id"})]
        out = None
        for k, part in enumerate(parts):
            df = self.single(part)
            out = df if out is None else out.union(df) if alls[k - 1] else out.union(df).distinct()
        return out

    def single(self, clauses: list) -> DataFrame:
        df = None
        for clause in clauses:
            if isinstance(clause, Match):
                df = self.match(df, clause)
            elif isinstance(clause, Projection):
                df = self.project(df, clause)
            else:
                values = self.expr(clause[1], df)
                df = df if df is not None else self.nodes.sparkSession.range(1).select()
                df = df.select("*", F.explode(values).alias(clause[2]))
        return df

    # Expressions.
    def column(self, df: DataFrame | None, var: str, prop: str) -> Column:
        prop = "node_id" if prop == "path" and "path" not in self.columns else prop
        prop = "rel" if prop == "type" and df is not None and f"{var}__rel" in df.columns else prop
        if df is None or f"{var}__{prop}" not in df.columns:
            raise CypherError(f"unknown property {var}.{prop}")
        return F.col(f"{var}__{prop}")

    def expr(self, e: tuple, df: DataFrame | None) -> Column:
        kind = e[0]
        if kind == "value":
            return F.lit(e[1])
        if kind == "list":
            return F.array(*map(F.lit, e[1]))
        if kind == "prop":
            return self.column(df, e[1], e[2])
        if kind == "var":
            if df is not None and e[1] in df.columns:
                return F.col(e[1])
            if df is not None and f"{e[1]}__nodes" in df.columns:
                return F.col(f"{e[1]}__nodes")
            own = [c for c in (df.columns if df is not None else []) if c.startswith(f"{e[1]}__")]
            if not own:
                raise CypherError(f"unknown variable {e[1]}")
            return F.struct(*[F.col(c).alias(c.split("__", 1)[1]) for c in own])
        if kind == "comprehension":
            if e[3][0] == "var" and e[3][1] == e[1]:
                return self.expr(e[2], df)
            if e[2][0] != "call" or e[2][1] != "nodes" or e[3][0] != "prop" or e[3][1] != e[1]:
                raise CypherError("only [v IN nodes(p) | v.prop] is known")
            prop = "node_id" if e[3][2] == "path" and "path" not in self.columns else e[3][2]
            if prop not in self.carried:
                raise CypherError(f"unknown property {e[1]}.{e[3][2]}")
            return F.transform(self.expr(e[2], df), lambda n: n[prop])
        if kind == "call":
            return self.call(e, df)
        if kind in ("and", "or"):
            a, b = self.expr(e[1], df), self.expr(e[2], df)
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.expr(e[1], df)
        if kind == "null":
            return self.expr(e[1], df).isNull()
        if kind == "xor":
            return self.expr(e[1], df).cast("boolean") != self.expr(e[2], df).cast("boolean")
        if kind == "in":
            return self.expr(e[1], df).isin(e[2][1]) if e[2][0] == "list" else F.array_contains(self.expr(e[2], df), self.expr(e[1], df))
        if kind in ("+", "-", "*", "/", "%"):
            a, b = self.expr(e[1], df), self.expr(e[2], df)
            if kind == "+" and "string" in (self.type(a, df), self.type(b, df)):
                return F.concat(a, b)
            return {"+": a.__add__, "-": a.__sub__, "*": a.__mul__, "/": a.__truediv__, "%": a.__mod__}[kind](b)
        a, b = self.expr(e[1], df), self.expr(e[2], df)
        return {"contains": a.contains, "starts": a.startswith, "ends": a.endswith, "like": lambda x: a.rlike(f"^(?:{e[2][1]})$"), "=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[kind](b)

    @staticmethod
    def type(value: Column, df: DataFrame | None) -> str:
        return df.select(value.alias("x")).schema[0].dataType.typeName() if df is not None else ""

    def call(self, e: tuple, df: DataFrame) -> Column:
        _, name, distinct, args = e
        if not args:
            raise CypherError(f"{name} takes a value")
        if name == "count" and args[0][0] == "star":
            return F.count(F.lit(1))
        if name in ("label", "labels") and args[0][0] == "var":
            return self.column(df, args[0][1], "label")
        x = self.key(args[0], df) if name in ("count", "collect") else self.expr(args[0], df)
        if name == "size":
            return F.size(x) if self.type(x, df) == "array" else F.length(x)
        if name in ("nodes", "length"):
            if args[0][0] != "var" or f"{args[0][1]}__nodes" not in df.columns:
                raise CypherError(f"{name} takes a named path")
            return x if name == "nodes" else F.size(x) - 1
        if name == "count":
            return F.count_distinct(x) if distinct else F.count(x)
        if name == "collect":
            return F.sort_array(F.collect_set(x) if distinct else F.collect_list(x))
        known = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "tolower": F.lower, "toupper": F.upper, "lower": F.lower, "upper": F.upper, "abs": F.abs}
        if name not in known:
            raise CypherError(f"unknown function {name}")
        return known[name](x)

    def key(self, e: tuple, df: DataFrame) -> Column:
        """A node variable counts by its id."""
        return F.col(f"{e[1]}__node_id") if e[0] == "var" and f"{e[1]}__node_id" in df.columns else self.expr(e, df)

    @staticmethod
    def aggregated(e: tuple) -> bool:
        return e[0] == "call" and e[1] in AGGREGATES

    # Clauses.
    def scan(self, node: Node) -> DataFrame:
        return self.such(self.nodes.select(*[F.col(c).alias(f"{node.var}__{c}") for c in self.columns]), node)

    def such(self, df: DataFrame, node: Node) -> DataFrame:
        """Rows whose node has the label and the properties."""
        if node.label:
            df = df.where(self.column(df, node.var, "label" if node.label in LABELS else "kind") == node.label)
        for k, v in node.props.items():
            df = df.where(self.column(df, node.var, k) == F.lit(v))
        return df

    def conditions(self, e: tuple | None) -> list[tuple]:
        return [] if e is None else self.conditions(e[1]) + self.conditions(e[2]) if e[0] == "and" else [e]

    def variables(self, e) -> set[str]:
        if not isinstance(e, tuple):
            return set()
        return {e[1]} if e[0] in ("prop", "var") else set().union(*[self.variables(x) for x in e[1:]], *[self.variables(y) for x in e[1:] if isinstance(x, list) for y in x])

    def match(self, df: DataFrame | None, clause: Match) -> DataFrame:
        if clause.optional and df is not None:
            used = {p.var for _, parts in clause.paths for p in parts} | self.variables(clause.where)
            shared = [c for c in df.columns if c.split("__")[0] in used]
            seeds = df.select(shared).distinct() if shared else None
            right = self.match(seeds, Match(clause.paths, clause.where, False))
            keys = [c for c in shared if c.endswith("__node_id") or "__" not in c]
            right = right.select(*[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns])
            out = df.join(right, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys] if keys else F.lit(True), "left")
            return out.drop(*[f"_r_{c}" for c in shared])
        todo = self.conditions(clause.where)
        single = {}
        for c in todo:
            if len(v := self.variables(c)) == 1:
                single.setdefault(next(iter(v)), []).append(c)

        def rows(node: Node) -> DataFrame:
            out = self.scan(node)
            for c in single.get(node.var, []):
                out = out.where(self.expr(c, out))
            return out

        for name, parts in clause.paths:
            first = parts[0]
            if df is None:
                df = rows(first)
            elif f"{first.var}__node_id" in df.columns:
                df = self.such(df, first)
            else:
                df = df.crossJoin(rows(first))  # two patterns without a common variable are a product in Cypher
            left, walked = first, [self.here(first.var)]
            for rel, node in zip(parts[1::2], parts[2::2], strict=True):
                df = self.step(df, left, rel, node, rows, f"{name}__w{len(walked)}" if name and rel.hops else None)
                walked.append(F.col(f"{name}__w{len(walked)}") if name and rel.hops else self.here(node.var))
                left = node
            if name:
                df = df.withColumn(f"{name}__nodes", F.concat(*walked)).drop(*[f"{name}__w{k}" for k in range(len(walked))])
        for c in todo:
            df = df.where(self.expr(c, df))
        return df

    def here(self, var: str) -> Column:
        """The node as a path of its own."""
        return F.array(F.struct(*[F.col(f"{var}__{c}").alias(c) for c in self.carried]))

    def step(self, df: DataFrame, left: Node, rel: Rel, node: Node, rows, walk: str | None) -> DataFrame:
        edges = self.edges if rel.type is None else self.edges.where(F.col("rel") == rel.type)
        a, b = F.col("src"), F.col("dst")
        pairs = edges.select(a.alias("_a"), b.alias("_b"), F.col("rel").alias(f"{rel.var}__rel"))
        back = edges.select(b.alias("_a"), a.alias("_b"), F.col("rel").alias(f"{rel.var}__rel"))
        pairs = {"out": pairs, "in": back}[rel.direction] if rel.direction != "both" else pairs.union(back)
        start = f"{left.var}__node_id"
        if rel.hops:
            starts = df.select(F.col(start).alias("_a")).distinct()
            pairs = self.walks(pairs.select("_a", "_b"), starts, *rel.hops, walk) if walk else self.expanded(pairs.select("_a", "_b"), starts, *rel.hops)
        df = df.join(pairs, F.col(start) == F.col("_a")).drop("_a")
        if f"{node.var}__node_id" in df.columns:
            return self.such(df.where(F.col("_b") == F.col(f"{node.var}__node_id")).drop("_b"), node)
        return df.join(rows(node), F.col("_b") == F.col(f"{node.var}__node_id")).drop("_b")

    def walks(self, pairs: DataFrame, starts: DataFrame, least: int, most: int, name: str) -> DataFrame:
        """(_a, _b, name): every walk of least to most hops from the starts, and the nodes it goes through after its start."""
        pairs = pairs if cheap(pairs) else written(pairs)
        nodes = self.nodes.select(F.col("node_id").alias("_n"), F.struct(*self.carried).alias("_node"))
        now = written(starts.select("_a", F.col("_a").alias("_b"), F.lit(None).cast(f"array<{nodes.schema['_node'].dataType.simpleString()}>").alias(name)))
        out = None if least else now.withColumn(name, F.array().cast(now.schema[name].dataType))
        for hop in range(1, most + 1):
            step = now.select("_a", F.col("_b").alias("_at"), name).join(pairs.withColumnRenamed("_a", "_at"), "_at").join(nodes, F.col("_b") == F.col("_n"))
            now = written(step.select("_a", "_b", F.concat(F.coalesce(F.col(name), F.array().cast(now.schema[name].dataType)), F.array("_node")).alias(name)))
            if hop >= least:
                out = now if out is None else out.union(now)
            if now.isEmpty():
                break
        return out if out is not None else now.limit(0)

    @staticmethod
    def expanded(pairs: DataFrame, starts: DataFrame, least: int, most: int) -> DataFrame:
        """(_a, _b) at a shortest distance from least to most hops, ends that differ."""
        pairs = pairs if cheap(pairs) else written(pairs.distinct())
        frontier = written(starts.select(F.col("_a").alias("s"), F.col("_a").alias("n")))
        seen, out = [frontier], []
        for hop in range(1, most + 1):
            found = frontier.join(pairs, F.col("n") == F.col("_a")).select("s", F.col("_b").alias("n")).distinct()
            for before in seen:
                found = found.join(before, ["s", "n"], "left_anti")
            frontier = written(found)
            if frontier.isEmpty():
                break
            seen.append(frontier)
            out += [frontier] if hop >= least else []
        return reduce(DataFrame.union, out or [frontier.limit(0)]).select(F.col("s").alias("_a"), F.col("n").alias("_b"))

    def project(self, df: DataFrame | None, p: Projection) -> DataFrame:
        df = df if df is not None else self.nodes.sparkSession.range(1).select()
        whole = lambda e: e[0] == "var" and e[1] not in df.columns

        def passed(e: tuple, name: str) -> list[Column]:
            if whole(e) and not p.final:
                return [F.col(c).alias(f"{name}__{c.split('__', 1)[1]}") for c in df.columns if c.startswith(f"{e[1]}__")]
            return [self.expr(e, df).alias(name)]

        if any(self.aggregated(e) for e, _ in p.items):
            groups = [c for e, n in p.items if not self.aggregated(e) for c in passed(e, n)]
            out = df.groupBy(*groups).agg(*[self.expr(e, df).alias(n) for e, n in p.items if self.aggregated(e)])
            out = out.select(*[F.col(f"`{c}`") for e, n in p.items for c in ([n] if n in out.columns else [x for x in out.columns if x.startswith(f"{n}__")])])
            keep = None
        else:
            keep = [c for e, n in p.items for c in passed(e, n)]
            out = df.select(*keep)
        out = out.distinct() if p.distinct else out
        if p.order:
            names = {n: F.col(f"`{n}`") for _, n in p.items}
            by_item = {str(e): F.col(f"`{n}`") for e, n in p.items}
            order = []
            for e, down in p.order:
                c = names.get(e[1]) if e[0] == "var" and e[1] in names else by_item.get(str(e))
                if c is None and keep is not None and not p.distinct:
                    out = df.select(*keep, self.expr(e, df).alias(f"_o{len(order)}")) if not order else out
                    c = F.col(f"_o{len(order)}")
                if c is None:
                    raise CypherError("ORDER BY takes what is returned")
                order.append(c.desc_nulls_last() if down else c.asc_nulls_last())
            out = out.orderBy(*order)
        if p.skip:
            out = out.offset(p.skip)
        if p.limit is not None:
            out = out.limit(p.limit)
        out = out.drop(*[c for c in out.columns if c.startswith("_o")])
        return out if p.where is None else out.where(self.expr(p.where, out))


def query(nodes: DataFrame, edges: DataFrame, text: str, params: dict | None = None) -> DataFrame:
    """The rows that a Cypher text returns. Raises CypherError for anything but reading clauses."""
    return Compiler(nodes, edges).run(text, params)
