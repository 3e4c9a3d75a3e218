"""Symbols and references of one TypeScript or JavaScript file, from its tokens and the pairs of its brackets."""

from __future__ import annotations

import re
from collections.abc import Iterator

CONTENT = 8000
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|$))|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<template>`(?:\\.|[^`\\])*`)
    |(?P<id>[#@]?[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\?\.|\.\.\.|[=!]==?|&&|\|\||.)""",
    re.X | re.S,
)
_MODIFIERS = {"public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "declare", "accessor"}
#: What a declaration may follow; after anything else `function` and `class` begin an expression.
_BEFORE = {"", ";", "{", "}", "export", "default", "async", "declare"}
_NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "super", "typeof", "await", "import", "constructor"}


class Scanner:
    def __init__(self, file: str, text: str) -> None:
        self.file, self.text = file, text
        self.kinds, self.words, self.spans, self.pair = [], [], [], {}
        opened: list[int] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            kind, end = m.lastgroup, m.end()
            if m[0] == "/" and (not self.words or self.kinds[-1] == "op" and self.words[-1] not in (")", "]", "}") or self.words[-1] == "return"):
                pattern = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(text, at)
                kind, end = ("str", pattern.end()) if pattern else (kind, end)
            if kind != "skip":
                word = text[at:end]
                if kind == "op" and word in "([{":
                    opened.append(len(self.words))
                elif kind == "op" and word in ")]}" and opened:
                    self.pair[opened.pop()] = len(self.words)
                self.kinds.append(kind)
                self.words.append(word)
                self.spans.append((at, end))
            at = end
        self.found: list[dict] = []
        self.known: dict[str, str] = {}
        self.bodies: list[tuple[str, str, int, int]] = []  # node, name, first and last token
        self.scan(0, len(self.words), file, None)

    def word(self, k: int) -> str:
        return self.words[k] if 0 <= k < len(self.words) else ""

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def body(self, k: int, end: int) -> int | None:
        """The bracket that opens a body after parameters or a heading that begin at k; none if a statement ends before."""
        while k < end:
            w = self.words[k]
            if w == "{" and self.kinds[k] == "op":
                if self.word(k - 1) in (":", "|", "&", "<", ",", "=>"):  # a type in brackets
                    k = self.pair.get(k, end) + 1
                    continue
                return k
            if w in (";", "}") and self.kinds[k] == "op":
                return None
            k = self.pair.get(k, k) + 1 if w in "([" and self.kinds[k] == "op" else k + 1
        return None

    def add(self, kind: str, mark: str, name: str, first: int, last: int, within: str, exported: bool, owner: str | None) -> str:
        a, b = self.spans[first][0], self.spans[last][1]
        node = {"fact": "node", "node_id": f"{self.file}#{kind}:{mark}", "kind": kind, "name": name, "start_line": self.line(a), "end_line": self.line(b - 1), "content": self.text[a:b][:CONTENT], "owner_name": owner, "is_exported": exported}
        self.found += [node, {"fact": "edge", "src": within, "dst": node["node_id"], "rel": "CONTAINS"}]
        return node["node_id"]

    def scan(self, k: int, end: int, within: str, owner: str | None) -> None:
        """Declarations among the tokens k to end, not those inside of functions and methods."""
        while k < end:
            w, before = self.words[k], self.word(k - 1)
            named = self.kinds[k] == "id" and k + 1 < end and self.kinds[k + 1] == "id"
            fresh = before in _BEFORE or self.text.count("\n", self.spans[k - 1][1], self.spans[k][0]) and (before in (")", "]") or self.kinds[k - 1] in ("id", "str", "num", "template"))
            start = k
            while self.word(start - 1) in ("async", "declare"):
                start -= 1
            exported = self.word(start - 1) == "export" or self.word(start - 1) == "default" and self.word(start - 2) == "export"
            if w == "function" and named and fresh and (opening := self.body(k + 2, end)) is not None:
                close = self.pair.get(opening, end - 1)
                node = self.add("function", self.words[k + 1], self.words[k + 1], start, close, within, exported, None)
                if owner is None:
                    self.known[self.words[k + 1]] = node
                self.bodies.append((node, self.words[k + 1], k + 1, close))
                k = close + 1
            elif w == "class" and named and fresh and before != "abstract" and (opening := self.body(k + 2, end)) is not None:
                close, name = self.pair.get(opening, end - 1), self.words[k + 1]
                node = self.add("class", name, name, k, close, within, exported, None)
                if owner is None:
                    self.known[name] = node
                self.members(opening + 1, close, node, name)
                k = close + 1
            else:
                k += 1

    def members(self, k: int, end: int, within: str, owner: str) -> None:
        while k < end:
            first = k
            while self.word(k) in _MODIFIERS | {"*"} and self.word(k + 1) not in ("(", "=", ":", ";"):
                k += 1
            at = k + 1
            if self.word(at) == "<":
                while at < end and self.words[at] != "(":
                    at += 1
            if self.kinds[k] == "id" and self.words[k][0] not in "#@" and self.word(at) == "(" and self.kinds[at] == "op":
                opening = self.body(self.pair.get(at, end) + 1, end)
                if opening is not None:
                    close, name = self.pair.get(opening, end - 1), self.words[k]
                    node = self.add("method", f"{owner}.{name}", name, first, close, within, False, owner)
                    self.bodies.append((node, name, k + 1, close))
                    k = close + 1
                    continue
            k = self.pair.get(k, k) + 1  # properties and their values: whole brackets at a time
            while k < end and self.kinds[k] == "op" and self.words[k] not in (";", "}", "*") and self.words[k] not in "([{":
                k += 1

    def references(self, k: int, end: int) -> tuple[set[str], set[str]]:
        """Capitalised names, but those inside of declarations, and called names of a body."""
        refs, calls, hidden = set(), set(), -1
        for at in range(k, end):
            if self.kinds[at] != "id":
                continue
            w, before = self.words[at], self.word(at - 1)
            if w in ("function", "class") and before in _BEFORE and self.kinds[at + 1] == "id" and at > hidden:
                opening = self.body(at + 2, end)
                hidden = self.pair.get(opening, end) if opening is not None else hidden
            if w[0].isupper() and before not in (".", "?.") and at > hidden:
                refs.add(w)
            if self.word(at + 1) == "(" and before not in ("new", "function") and w not in _NO_CALL:
                calls.add(w)
        return refs, calls

    def facts(self) -> Iterator[dict]:
        refs = {node: self.references(a, b) for node, _, a, b in self.bodies}
        for fact in self.found:
            yield fact | {"scope_refs": sorted(refs[fact["node_id"]][0]) or None} if fact["fact"] == "node" and fact["node_id"] in refs else fact
        for name, node in self.known.items():
            yield {"fact": "symbol", "name": name, "node_id": node}
        for node, name, _, _ in self.bodies:
            for ref in sorted(refs[node][0]):
                yield {"fact": "ref", "src": node, "name": ref, "how": "calls"}
            for called in sorted(refs[node][1]) if name in self.known else ():
                yield {"fact": "call", "src": self.known[name], "name": called, "how": "imported"}


def symbols(file: str, text: str) -> Iterator[dict]:
    return Scanner(file, text).facts()
