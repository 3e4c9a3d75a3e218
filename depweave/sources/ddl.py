"""Tables and foreign keys of one file of SQL, by walking its tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Columns of a table's summary, words that start no column.
COLUMNS = 50
NO_COLUMN = {"CONSTRAINT", "PRIMARY", "UNIQUE", "INDEX", "KEY", "CHECK", "FOREIGN", "EXCLUDE", "TABLESPACE"}
_TOKEN = re.compile(r"""(?P<gap>[^\S\n]+|--[^\n]*|/\*.*?\*/)|(?P<line>\n)|(?P<text>'(?:''|[^'])*')|(?P<name>"[^"]*"|`[^`]*`|\w+)|(?P<mark>.)""", re.S)


class Tokens:
    def __init__(self, text: str) -> None:
        """Words without gaps; each with its line and whether it is the first one there."""
        self.text, self.words, self.spans, self.names, self.lines, self.first, self.at, line, fresh = text, [], [], [], [], [], 0, 1, True
        for m in _TOKEN.finditer(text):
            if m.lastgroup in ("gap", "line"):
                line, fresh = line + m[0].count("\n"), fresh or "\n" in m[0]
                continue
            self.words.append(m[0])
            self.spans.append(m.span())
            self.names.append(m.lastgroup == "name")
            self.lines.append(line)
            self.first.append(fresh)
            line, fresh = line + m[0].count("\n"), False

    def ahead(self, k: int = 0) -> str:
        return self.words[self.at + k] if self.at + k < len(self.words) else ""

    def take(self, *words: str) -> bool:
        """Go past the words if they come next, in any case."""
        if all(self.ahead(k).upper() == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def name(self) -> str | None:
        """The last part of a name with or without a schema."""
        out = None
        while self.at < len(self.words) and self.names[self.at]:
            out = self.words[self.at].strip('"`')
            self.at += 1
            if not self.take("."):
                break
        return out

    def bracket(self) -> int:
        """Where the bracket that opens here closes."""
        depth, k = 0, self.at
        while k < len(self.words):
            depth += {"(": 1, ")": -1}.get(self.words[k], 0)
            if not depth:
                return k
            k += 1
        return k


def _key(t: Tokens) -> str | None:
    """The table that a foreign key refers to, if one is declared here."""
    if not t.take("FOREIGN", "KEY") or t.ahead() != "(":
        return None
    t.at = t.bracket() + 1
    return t.name() if t.take("REFERENCES") else None


def _columns(t: Tokens, start: int, end: int) -> list[str]:
    out = []
    for k in range(start, end - 1):
        if (t.first[k] or k == start) and t.names[k] and t.names[k + 1] and t.words[k].upper() not in NO_COLUMN:
            last = k + 1
            if k + 2 < end and t.words[k + 2] == "(":
                t.at = k + 2
                last = min(t.bracket(), end - 1)
            kind = t.text[t.spans[k + 1][0] : t.spans[last][1]]
            out.append(f"{t.words[k].strip(chr(34) + '`')} {kind.lower()}")
    return out


def tables(text: str) -> tuple[dict[str, tuple[int, str]], list[tuple[str, str]]]:
    """{table: (line, summary of its columns)} and foreign keys as (table, other); of an ALTER TABLE the first key counts."""
    t, found, keys = Tokens(text), {}, []
    while t.at < len(t.words):
        start = t.at
        if t.take("CREATE", "TABLE"):
            t.take("IF", "NOT", "EXISTS")
            name = t.name()
            if name is None or t.ahead() != "(":
                continue
            inside, end = t.at + 1, t.bracket()
            if name not in found:
                found[name] = (t.lines[start], ", ".join(_columns(t, inside, end)[:COLUMNS]))
            t.at = inside
            while t.at < end:
                other = _key(t)
                keys += [(name, other)] if other else []
                t.at += other is None
            t.at = min(end, len(t.words))
        elif t.take("ALTER", "TABLE"):
            t.take("ONLY")
            name, other = t.name(), None
            while name and other is None and t.ahead() not in (";", ""):
                other = _key(t)
                t.at += other is None
            keys += [(name, other)] if other else []
        else:
            t.at += 1
    return found, keys


def symbols(file: str, text: str) -> Iterator[dict]:
    """Tables, and foreign keys between tables of the file."""
    found, keys = tables(text)
    for name, (line, columns) in found.items():
        node_id = f"{file}#db_table:{name}"
        yield {"fact": "node", "node_id": node_id, "kind": "db_table", "name": name, "start_line": line, "end_line": 0, "content": columns, "is_exported": False}
        yield {"fact": "edge", "src": file, "dst": node_id, "rel": "CONTAINS"}
    for a, b in keys:
        if a != b and a in found and b in found:
            yield {"fact": "edge", "src": f"{file}#db_table:{a}", "dst": f"{file}#db_table:{b}", "rel": "DEPENDS_ON"}
