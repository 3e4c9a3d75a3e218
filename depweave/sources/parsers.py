"""What one source file says, as flat facts; files are parsed apart from each other, so facts of many files are one distributed pass.

Facts: `file` (the start of its text), `import` (candidates: paths in order of preference), `node`, `edge` (src, dst, rel), `symbol` (name by which
other files find node_id), `ref` (src, name, how: inherits, uses or calls) and `call` (src: caller, name: callee, how: imported or anywhere).
Python is parsed by the standard library's ast, the others by scanners of their own. A file that can't be parsed has no facts but `file`.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Callable, Iterator

from . import ddl, ruby, script

#: Characters of a symbol's and of a file's content, endings tried for a TypeScript import.
CONTENT, FILE_CONTENT = 8000, 2000
SCRIPT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]

Fact = dict


def _import(candidates: list[str]) -> Fact:
    """Paths that leave the root are no candidates."""
    paths = [posixpath.normpath(c) for c in candidates]
    return {"fact": "import", "candidates": [p for p in paths if p != "." and not p.startswith(("../", "/")) and p != ".."]}


def _node(file: str, kind: str, name: str, start: int, end: int, content: str, within: str, label: str | None = None, owner: str | None = None) -> Iterator[Fact]:
    node_id = f"{file}#{kind}:{name}"
    yield {"fact": "node", "node_id": node_id, "kind": kind, "name": label or name, "start_line": start, "end_line": end, "content": content[:CONTENT], "owner_name": owner, "is_exported": False}
    yield {"fact": "edge", "src": within, "dst": node_id, "rel": "CONTAINS"}


def _python_import(file: str, node: ast.AST) -> Iterator[Fact]:
    forms = lambda path: [f"{path}.py", f"{path}/__init__.py"]
    modules = [a.name for a in node.names if not a.asname] if isinstance(node, ast.Import) else [node.module] if not node.level else []
    for module in modules:
        path = module.replace(".", "/")
        yield _import(forms(path) + forms(f"src/{path}"))
    if isinstance(node, ast.ImportFrom) and node.level:
        anchor = posixpath.join(posixpath.dirname(file) or ".", *[".."] * (node.level - 1))
        yield _import(forms(f"{anchor}/{node.module.replace('.', '/')}") if node.module else [f"{anchor}/__init__.py"])


def _source(lines: list[bytes], node: ast.AST) -> str:
    part = lines[node.lineno - 1 : node.end_lineno]
    part[-1] = part[-1][: node.end_col_offset]
    return b"\n".join([part[0][node.col_offset :], *part[1:]]).decode("utf-8", "ignore")


def _python(file: str, text: str, symbols: bool) -> Iterator[Fact]:
    tree = ast.parse(text)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom):
            yield from _python_import(file, node)
    if not symbols:
        return
    lines = text.encode().split(b"\n")
    top, bodies = set(), []
    todo: list[tuple[ast.AST, str, str | None]] = [(tree, file, None)]  # a node, what contains it, its innermost class
    while todo:
        node, within, owner = todo.pop()
        inner = []
        for child in ast.iter_child_nodes(node):
            source = _source(lines, child) if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else ""
            if isinstance(child, ast.ClassDef):
                yield from _node(file, "class", child.name, child.lineno, child.end_lineno, source, within)
                top |= {("class", child.name)} if owner is None else set()
                inner.append((child, f"{file}#class:{child.name}", child.name))
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                kind, name = ("function", child.name) if owner is None else ("method", f"{owner}.{child.name}")
                yield from _node(file, kind, name, child.lineno, child.end_lineno, source, within, child.name, owner)
                top |= {("function", child.name)} if owner is None else set()
                bodies.append(child)
            else:
                inner.append((child, within, owner))
        todo += reversed(inner)
    for body in bodies:  # a method speaks for the top-level symbol of its name, if there is one
        kinds = [kind for kind, name in sorted(top, reverse=True) if name == body.name]
        called = {n.func.id for n in ast.walk(body) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
        for name in sorted(called) if kinds else ():
            yield {"fact": "call", "src": f"{file}#{kinds[0]}:{body.name}", "name": name, "how": "imported"}
    for kind, name in sorted(top):
        yield {"fact": "symbol", "name": name, "node_id": f"{file}#{kind}:{name}"}


#: Comments and strings are matched as a whole, so what they hold is no import.
_SCRIPT = re.compile(
    r"""//[^\n]*|/\*.*?\*/|\b(?:import|export)\b(?:[^;'"()`=]*?\bfrom)?\s*["'](?P<import>[^"'\n]*)["']|(?<![.\w])require\s*\(\s*["'](?P<require>[^"'\n]*)["']"""
    r"""|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""",
    re.S,
)


def _script(file: str, text: str, symbols: bool) -> Iterator[Fact]:
    """Endings are appended, so './user.service' is user.service.ts."""
    named = (m["import"] or m["require"] or "" for m in _SCRIPT.finditer(text))
    for path in named:
        if not path.startswith("."):
            continue
        base = posixpath.join(posixpath.dirname(file), path)
        yield _import([base + ending for ending in SCRIPT_ENDINGS])
    if symbols:
        yield from script.symbols(file, text)


_RUBY_IMPORT = re.compile(r"""^(?:[^#\n"']|"[^"\n]*"|'[^'\n]*')*?\b(require_relative|require_dependency|require|autoload)\b[ \t(]+(?::\w+\s*,\s*)?["']([^"'#\n]+)["']""", re.M)


def _ruby(file: str, text: str, symbols: bool) -> Iterator[Fact]:
    for how, path in _RUBY_IMPORT.findall(text):
        base = posixpath.join(posixpath.dirname(file), path) if how == "require_relative" else path
        yield _import([base, f"{base}.rb"])
    if symbols:
        yield from ruby.symbols(file, text)


def _sql(file: str, text: str, symbols: bool) -> Iterator[Fact]:
    if symbols:
        yield from ddl.symbols(file, text)


PARSERS: dict[str, Callable[[str, str, bool], Iterator[Fact]]] = {"python": _python, "typescript": _script, "javascript": _script, "ruby": _ruby, "sql": _sql}


def facts(file: str, language: str, content: bytes, symbols: bool) -> list[Fact]:
    text = content.decode("utf-8", "ignore")
    own = {"fact": "file", "content": text[:FILE_CONTENT]}
    try:
        return [own, *PARSERS[language](file, text, symbols)]
    except (SyntaxError, ValueError, RecursionError):  # of Python's parser
        return [own]
