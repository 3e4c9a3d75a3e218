"""Symbols, macros and references of one Ruby file, from one pass over its tokens.

The scanner keeps a stack of what is open (class, module, method, block, brace) and looks at macros where a statement begins outside of methods.
Strings, comments, regular expressions and heredocs are tokens as a whole; what a string interpolates counts as referred to.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Macros by the kind of node that they make.
HOOKS = """
after_action after_commit after_create after_destroy after_find after_initialize after_rollback after_save after_update after_validation
around_action around_commit around_create around_destroy around_save around_update around_validation
before_action before_commit before_create before_destroy before_initialize before_save before_update before_validation skip_after_action skip_before_action
""".split()
ASSOCIATIONS = "belongs_to has_one has_many has_and_belongs_to_many has_one_through has_many_through".split()
VALIDATIONS = """
validate validates validates_each validates_with validates_presence_of validates_uniqueness_of validates_format_of validates_length_of validates_numericality_of
validates_inclusion_of validates_exclusion_of validates_confirmation_of validates_acceptance_of
""".split()
SCOPES = "scope default_scope".split()
MIXINS = "include extend prepend".split()
ATTRIBUTES = "attr_accessor attr_reader attr_writer cattr_accessor cattr_reader cattr_writer mattr_accessor mattr_reader mattr_writer".split()
DELEGATIONS = "delegate delegates".split()
KINDS = {
    **dict.fromkeys(HOOKS, "hook"), **dict.fromkeys(ASSOCIATIONS, "association"), **dict.fromkeys(VALIDATIONS, "validation"), **dict.fromkeys(SCOPES, "scope"), **dict.fromkeys(MIXINS, "mixin"),
    **dict.fromkeys(ATTRIBUTES, "attr"), **dict.fromkeys(DELEGATIONS, "delegate"), "enum": "enum", "alias_method": "alias", "store_accessor": "attr", "helper_method": "helper_method", "rescue_from": "rescue_from", "define_method": "method",
}
#: Characters of a class's or method's, a macro's and a constant's content; names of macros without the argument they are named by.
CONTENT, MACRO_CONTENT, CONSTANT_CONTENT = 8000, 2000, 500
NO_CALLBACK, UNKNOWN = "__block__", "__unknown__"

_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+|\\\n|\#[^\n]*|(?:^=begin\b.*?^=end\b[^\n]*))|(?P<nl>\n|;)
    |(?P<heredoc><<[~-](?P<q>["'`]?)(?P<tag>[A-Za-z_]\w*)(?P=q)|<<(?P<q2>["'`]?)(?P<tag2>[A-Z_]{2,})(?P=q2))
    |(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)
    |(?P<sym>:"(?:\\.|[^"\\])*"|(?<![:\w]):[^\W\d]\w*[?!=]?(?![=]?>)|(?<![:\w]):(?:\[\]=?|<=>|[=!]=|=~|[-+*/<>%!~^&|]+))
    |(?P<key>[^\W\d]\w*[?!]?:(?![:]))|(?P<const>(?:::)?[A-Z]\w*(?:::[A-Z]\w*)*)|(?P<id>[^\W\d]\w*(?:[?!](?!=))?)|(?P<var>@@?\w+|\$\S)|(?P<num>\d[\w.]*)
    |(?P<op><=>|\*\*=?|===?|=~|=>|!=|!~|<=|>=|<<|>>|&&=?|\|\|=?|&\.|\.\.\.?|->|::|[-+*/%|&^]=|.)""",
    re.X | re.S | re.M,
)
_VALUE = {"id", "const", "num", "str", "sym", "var"}
_NO_VALUE = set("if unless while until and or not when in then do else elsif begin case return yield puts raise".split())
_OPENERS, _CONDITIONS = {"begin", "case", "for"}, {"if", "unless", "while", "until"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, waiting = 0, []
    while at < len(text):
        last = out[-1] if out else None
        value = last is not None and (last.kind in _VALUE and last.text not in _NO_VALUE or last.text in (")", "]", "}"))
        spaced = at > 0 and text[at - 1] in " \t" and at + 1 < len(text) and text[at + 1] not in " ="
        literal = re.compile(r"%[qQwWiIr]?([\[({<|!/])").match(text, at) if text[at] == "%" and (not value or spaced and last.kind == "id") else None
        if literal or text[at] == "/" and (not value or spaced and last.kind == "id"):
            end = _closing(text, literal.end() if literal else at + 1, literal[1] if literal else "/")
            kind = "str" if literal else "regex"
        else:
            m = _TOKEN.match(text, at)
            kind, end = m.lastgroup, m.end()
            if m["heredoc"]:
                kind = "str"
                waiting.append(m["tag"] or m["tag2"])
        if kind != "space":
            out.append(Token(kind, text[at:end], at, end))
            if kind == "str" and text[at] != "'":
                out += [Token(f"in_{t.kind}", t.text, at, at) for part in re.findall(r"#\{([^{}]*)\}", text[at:end]) for t in tokens(part) if t.kind in ("id", "const")]
        if kind == "nl" and text[at] == "\n":
            for tag in waiting:
                m = re.compile(rf"^[ \t]*{tag}[ \t]*$", re.M).search(text, end)
                end = m.end() if m else len(text)
            waiting = []
        at = end
    return out


def _closing(text: str, at: int, opener: str) -> int:
    """The end of a literal that opener began before at, at the end of its line if it is a pattern that doesn't close there."""
    closer, depth, start = _PAIRS.get(opener, opener), 1, at
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c == closer:
            depth -= 1
            if not depth:
                return at + 1
        elif c == opener:
            depth += 1
        elif c == "\n" and opener == "/":
            return start
        at += 1
    return at


@dataclass
class Frame:
    kind: str  # class, module, method, singleton, eval, macro (its block is not looked into), block, brace
    name: str = ""
    node: dict | None = None
    names: set = field(default_factory=set)
    refs: set = field(default_factory=set)


class Scanner:
    def __init__(self, file: str, text: str) -> None:
        self.file, self.text, self.tokens = file, text, tokens(text)
        self.frames: list[Frame] = []
        self.nodes: dict[str, dict] = {}
        self.known: dict[str, str] = {}  # names by which other files find a symbol
        self.methods: list[tuple[str, Frame]] = []
        self.refs: list[tuple[str, str, str]] = []  # (src, name, how)
        self.lines = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def prefix(self) -> str:
        return "::".join(f.name for f in self.frames if f.kind in ("class", "module", "eval"))

    def parent(self) -> str:
        return next((f.node["node_id"] for f in reversed(self.frames) if f.kind in ("class", "module")), self.file)

    def hidden(self) -> bool:
        return any(f.kind in ("method", "macro") for f in self.frames)

    def add(self, kind: str, mark: str, name: str, start: int, end: int, content: int, **more) -> dict | None:
        node_id = f"{self.file}#{mark}"
        if node_id in self.nodes:
            return None
        self.nodes[node_id] = {"node_id": node_id, "kind": kind, "name": name, "start_line": self.line(start), "content": self.text[start:end][:content], "within": self.parent()} | more
        return self.nodes[node_id]

    def run(self) -> Scanner:
        t, k, waits = self.tokens, 0, False
        while k < len(t):
            tok, before = t[k], t[k - 1] if k else Token("nl", "", 0, 0)
            first = before.kind == "nl" or before.text in ("then", "else", "begin", "do", "ensure") or before.text in ("{", "|") and self.frames and self.frames[-1].kind in ("brace", "block", "macro", "eval")
            plain = tok.kind == "id" and before.text not in (".", "&.", "def", "alias", "undef")
            step = 1
            if tok.kind.endswith("const") or tok.kind.endswith("id"):
                self.referred(tok, before)
            if tok.text == "{":
                self.frames.append(Frame("brace"))
            elif tok.text == "}":
                self.close(("brace", "macro-brace", "eval-brace"), tok.end)
            elif plain and tok.text == "end":
                self.close(None, tok.end)
            elif plain and tok.text == "class":
                step = self.open_class(k)
            elif plain and tok.text == "module" and k + 1 < len(t) and t[k + 1].kind == "const":
                self.open("module", t[k + 1].text, tok)
                step = 2
            elif plain and tok.text == "def":
                step = self.open_method(k)
            elif plain and tok.text in _OPENERS:
                self.frames.append(Frame("block"))
                waits = tok.text == "for"
            elif plain and tok.text in _CONDITIONS and (first or before.kind in ("op", "key") and before.text not in (")", "]", "}")):
                self.frames.append(Frame("block"))
                waits = tok.text in ("while", "until")
            elif plain and tok.text == "do":
                if not waits:
                    self.frames.append(Frame("block"))
                waits = False
            elif tok.kind == "nl":
                waits = False
            elif not self.hidden():
                step = self.statement(k, first or before.text in ("private", "protected", "public"))
            k += step
        return self

    def referred(self, tok: Token, before: Token) -> None:
        for f in reversed(self.frames):
            if f.kind in ("class", "module", "singleton"):
                break
            if f.kind == "method":
                if tok.kind.endswith("const"):
                    f.refs.add(tok.text)
                elif tok.text not in ("def", "end", "self"):
                    f.names.add(tok.text)

    def close(self, kinds: tuple | None, end: int) -> None:
        """`end` closes the last that isn't a brace, and a bracket the last brace; what was left open inside goes with it."""
        for at in range(len(self.frames) - 1, -1, -1):
            f = self.frames[at]
            if (f.name == "{" or f.kind == "brace") == (kinds is not None):
                del self.frames[at:]
                if f.node:
                    f.node["end_line"] = self.line(end - 1)
                    f.node["content"] = self.text[f.node.pop("at") : end][:CONTENT]
                return

    def open(self, kind: str, name: str, tok: Token) -> None:
        scope = self.prefix()
        full = f"{scope}::{name}" if scope else name
        if self.hidden():
            self.frames.append(Frame("macro"))
            return
        node = self.add(kind, f"{kind}:{full}", name, tok.start, tok.start, CONTENT, end_line=0, is_exported=False, at=tok.start)
        node = node or {"node_id": f"{self.file}#{kind}:{full}", "at": tok.start}
        self.known[full] = self.known[name.split("::")[-1]] = node["node_id"]
        self.known.setdefault(name, node["node_id"])
        self.frames.append(Frame(kind, name, node))

    def open_class(self, k: int) -> int:
        t = self.tokens
        if k + 1 < len(t) and t[k + 1].text == "<<":
            self.frames.append(Frame("singleton"))
            return 3
        if k + 1 >= len(t) or t[k + 1].kind != "const":
            return 1
        self.open("class", t[k + 1].text, t[k])
        if k + 3 < len(t) and t[k + 2].text == "<" and t[k + 3].kind == "const" and self.frames[-1].kind == "class":
            self.refs.append((self.frames[-1].node["node_id"], t[k + 3].text.split("::")[-1], "inherits"))
            return 4
        return 2

    def open_method(self, k: int) -> int:
        t, at, own = self.tokens, k + 1, False
        if at + 1 < len(t) and t[at + 1].text == ".":
            own, at = True, at + 2
        if at >= len(t):
            return 1
        name, end = t[at].text, t[at].end
        if t[at].kind == "key":
            name, end = name[:-1], end - 1
        named = t[at].kind in ("id", "const", "key")
        if named and self.text[end : end + 1] == "=" and self.text[end : end + 2] not in ("==", "=>", "=~") and re.match(r"=\s*\(?\s*\w", self.text[end:]) and name[-1] not in "?!":
            named, at = False, at + 1  # a setter; tree and names know it as an operator of its own
        after = at + 1
        if after < len(t) and t[after].text == "(":
            depth = 0
            while after < len(t):
                depth += {"(": 1, ")": -1}.get(t[after].text, 0)
                after += 1
                if not depth:
                    break
        frame = Frame("method", name)
        hidden = self.hidden()
        if named and not hidden:
            scope = self.prefix()
            single = own or any(f.kind == "singleton" for f in self.frames[-1:])
            full = f"{scope}.{name}" if scope else name
            node = self.add("class_method" if single else "method", f"method:{full}", name, t[k].start, t[k].start, CONTENT, end_line=0, is_exported=False, owner_name=scope, at=t[k].start)
            frame.node = node
            if node and sum(f.kind in ("class", "module", "eval") for f in self.frames) == 1:
                self.known[full] = node["node_id"]
            self.methods.append((name, frame))
        if after < len(t) and t[after].text == "=" and named:  # def x = value
            upto = after
            while upto < len(t) and t[upto].kind != "nl":
                upto += 1
            for tok in t[at:upto]:
                (frame.refs if tok.kind.endswith("const") else frame.names if tok.kind.endswith("id") else set()).add(tok.text)
            if frame.node:
                frame.node |= {"end_line": self.line(t[upto - 1].start), "content": self.text[frame.node.pop("at") : t[upto - 1].end][:CONTENT]}
            return upto - k
        frame.names.add(name)
        self.frames.append(frame)
        return at + 1 - k

    def statement(self, k: int, first: bool) -> int:
        """Macros, constants and reopened classes; how many tokens are done with."""
        t, tok = self.tokens, self.tokens[k]
        after = t[k + 1] if k + 1 < len(t) else Token("nl", "", tok.end, tok.end)
        received = k >= 2 and t[k - 1].text == "." and t[k - 2].kind == "const"
        if tok.kind == "const" and first and after.text == "=" and "::" not in tok.text:
            return self.constant(k)
        if tok.kind != "id" or not (first or received):
            return 1
        if tok.text == "alias" and k + 2 < len(t) and after.kind == t[k + 2].kind == "id":
            self.add("alias", f"alias:{after.text}", after.text, tok.start, t[k + 2].end, CONSTANT_CONTENT)
            return 3
        if received and tok.text in ("class_eval", "module_eval") and after.text in ("do", "{"):
            self.frames.append(Frame("eval", t[k - 2].text.split("::")[-1]) if after.text == "do" else Frame("brace"))
            return 2
        if tok.text not in KINDS or after.kind == "nl" or after.text in (".", "=", "&."):
            return 1
        args, upto = self.arguments(k + 1)
        if not args and (upto >= len(t) or t[upto].text not in ("do", "{")):
            return upto - k
        self.macro(tok, args, t[upto - 1].end)
        if upto < len(t) and t[upto].text == "do":
            self.frames.append(Frame("macro"))
            return upto + 1 - k
        if upto < len(t) and t[upto].text == "{":
            self.frames.append(Frame("macro", "{"))
            return upto + 1 - k
        return upto - k

    def arguments(self, k: int) -> tuple[list[list[Token]], int]:
        """Tokens of each argument, and where the statement or its block goes on."""
        t, depth, args = self.tokens, 0, [[]]
        wrapped = k < len(t) and t[k].text == "("
        k += wrapped
        while k < len(t):
            tok = t[k]
            if not depth and (wrapped and tok.text == ")" or not wrapped and (tok.kind == "nl" and t[k - 1].text not in (",", "=>", "(", "[", "{", "|", "&&", "||", "+", ".") and t[k - 1].kind != "key" or tok.text in ("do", "if", "unless") and tok.kind == "id")):
                k += wrapped
                break
            if not depth and not wrapped and tok.text == "{" and not args[-1] and len(args) == 1:
                break
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(tok.text, 0) if tok.kind == "op" else 0
            if tok.text == "," and not depth:
                args.append([])
            elif tok.kind != "nl" and not tok.kind.startswith("in_"):
                args[-1].append(tok)
            k += 1
        return [a for a in args if a], k

    def macro(self, tok: Token, args: list[list[Token]], end: int) -> None:
        word = lambda x: x.text[1:] if x.kind == "sym" else x.text.strip("'\"")
        single = [a[0] for a in args if len(a) == 1]
        symbols = [word(a) for a in single if a.kind == "sym"]
        names = [word(a) for a in single if a.kind in ("sym", "str")]
        constants = [a.text for a in single if a.kind == "const"]
        pairs = [a for a in args if a[0].kind == "key" or len(a) > 2 and a[1].text == "=>"]
        macro, kind = tok.text, KINDS[tok.text]
        put = lambda mark, name: self.add(kind, f"{kind}:{mark}", name, tok.start, end, MACRO_CONTENT, dsl_macro=macro)
        if kind == "hook":
            name = f"{macro}:{symbols[0] if symbols else NO_CALLBACK}"
            put(name, name)
        elif kind in ("association", "validation", "scope"):
            name = names[0] if names else UNKNOWN
            made = put(name if kind == "scope" else f"{macro}:{name}", name)
            if made and kind == "association" and name != UNKNOWN:
                self.refs.append((made["within"], constant_name(name), "uses"))
        elif kind in ("mixin", "rescue_from"):
            name = constants[0] if constants else UNKNOWN
            made = put(f"{macro}:{name}" if kind == "mixin" else name, name)
            if kind == "mixin" and macro == "extend" and "Concern" in name:
                for f in self.frames:
                    if f.kind == "module":
                        f.node["kind"] = "concern"
            if made and name != UNKNOWN:
                self.refs.append((made["within"], name, "uses"))
        elif kind in ("attr", "helper_method"):
            for name in symbols[1:] if macro == "store_accessor" else symbols:
                put(name, name)
        elif kind == "enum":
            name = pairs[0][0].text.strip(":'\"") if pairs else symbols[0] if symbols else UNKNOWN
            put(name, name)
        elif kind == "delegate":
            put(symbols[0] if symbols else UNKNOWN, symbols[0] if symbols else UNKNOWN)
        elif kind == "alias" and len(symbols) > 1:
            put(symbols[0], symbols[0])
        elif kind == "method" and symbols:
            scope = self.prefix()
            full = f"{scope}.{symbols[0]}" if scope else symbols[0]
            made = self.add("method", f"method:{full}", symbols[0], tok.start, end, MACRO_CONTENT, end_line=self.line(end - 1), is_exported=False, owner_name=scope)
            if made and sum(f.kind in ("class", "module", "eval") for f in self.frames) == 1:
                self.known[full] = made["node_id"]

    def constant(self, k: int) -> int:
        t, scope, upto, depth = self.tokens, self.prefix(), k + 2, 0
        while upto < len(t) and (depth or t[upto].kind != "nl") and t[upto].text != "do":
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(t[upto].text, 0) if t[upto].kind == "op" else 0
            upto += 1
        made = [x.text for x in t[k + 2 : k + 5]]
        kind = {"Struct.new": "struct", "Data.define": "data_class"}.get("".join(made), "constant")
        name = t[k].text
        node = self.add(kind, f"{kind}:{scope}::{name}" if scope else f"{kind}:{name}", name, t[k].start, t[upto - 1].end, CONSTANT_CONTENT)
        if node and not scope:
            self.known[name] = node["node_id"]
        if upto < len(t) and t[upto].text == "do":
            self.frames.append(Frame("macro"))
            return upto + 1 - k
        return upto - k

    def facts(self) -> Iterator[dict]:
        for node in self.nodes.values():
            node.pop("at", None)
            within = node.pop("within")
            refs = next((f.refs for _, f in self.methods if f.node is node), set())
            yield {"fact": "node"} | node | {"scope_refs": sorted(refs) or None}
            yield {"fact": "edge", "src": within, "dst": node["node_id"], "rel": "CONTAINS"}
            for ref in sorted(refs):
                yield {"fact": "ref", "src": node["node_id"], "name": ref, "how": "calls"}
        for name, node_id in self.known.items():
            yield {"fact": "symbol", "name": name, "node_id": node_id}
        for src, name, how in self.refs:
            yield {"fact": "ref", "src": src, "name": name, "how": how}
        for name, frame in self.methods:
            caller = self.known.get(name) or next((v for key, v in self.known.items() if key.endswith(f".{name}")), None)
            for called in sorted(frame.names) if caller else ():
                yield {"fact": "call", "src": caller, "name": called, "how": "anywhere"}


def constant_name(association: str) -> str:
    """The class that an association's name stands for: id suffix off, singular, words capitalised and joined."""
    stem = re.sub(r"_ids?$", "", association)
    for plural, one in (("ies", "y"), ("ses", "s"), ("xes", "x"), ("zes", "z")):
        if stem.endswith(plural):
            stem = stem[: -len(plural)] + one
            break
    else:
        stem = re.sub(r"(?<!s)s$", "", stem)
    return "".join(word.capitalize() for word in stem.split("_"))


def symbols(file: str, text: str) -> Iterator[dict]:
    return Scanner(file, text).run().facts()
