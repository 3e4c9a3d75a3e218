"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The most frequent words of all documents are encoded once and compiled into an automaton that shares prefixes
and suffixes; how many words lie before the one reached numbers it, and the number leads to its ids.  The automaton is one block of bytes
of bounded size, broadcast and memory-mapped by every worker.  Words that it doesn't hold are merged by rank exactly.
Results are those of the tokenizer file's own rules: special tokens in the raw text first, then NFC, lower case, the file's
split pattern and byte-level merges with word ends.  Decoding joins the tokens of the ids with a space, as that file has no decoder.

Null counts as empty; an empty text has no ids and decodes to the empty string.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import mmap
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, slices, table, utf8

#: Words in the automaton, entries of a worker's cache of results.
FREQUENT, CACHE = 16_384, 200_000
#: Bytes of texts that are worked on at once.
STEP = 1 << 20


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, the others for letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


LETTERS = byte_letters()


class Rules:
    """A tokenizer file's vocabulary, merges, pattern and special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.ranks: dict[tuple[str, str], int] = {m: k for k, m in enumerate(pairs)}
        self.end: str = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern: str = split["pattern"]["Regex"]
        self.token = {v: k for k, v in self.vocab.items()} | {v: k for k, v in self.special.items()}

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the adjacent pair of lowest rank, leftmost first, is joined until none is left."""
        parts = [LETTERS[b] for b in word.encode("utf-8", "replace")]
        parts[-1] += self.end
        if len(parts) > 256:
            return self._merge_long(parts)
        none = len(self.ranks)
        rank = self.ranks.get
        order = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while order and (best := min(order)) < none:
            at = order.index(best)
            parts[at] += parts.pop(at + 1)
            del order[at]
            if at:
                order[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(order):
                order[at] = rank((parts[at], parts[at + 1]), none)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same with a heap and links between neighbours, for very long words."""
        import heapq

        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], right[i] = a + b, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.vocab[p] for p, ok in zip(parts, alive, strict=True) if ok and p in self.vocab]


def lower(text: str) -> str:
    """Each character's own lower case, whatever stands next to it."""
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def compile_words(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the entries' keys, with ids by word number, as one block.

    Words come in order; states are finished from the longest common prefix on and looked up among
    equal finished ones.  Block: 4 counts, then per state first arc and final flag, per arc byte, target and words skipped, then ids by word.
    """
    states: list[tuple[dict[int, int], bool]] = []
    register: dict[tuple, int] = {}

    def finish(node: list) -> int:
        key = (node[0], tuple(sorted(node[1].items())))
        if key not in register:
            register[key] = len(states)
            states.append((dict(sorted(node[1].items())), node[0]))
        return register[key]

    path: list[list] = [[False, {}]]
    last = b""
    words = sorted(entries)
    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        for i in range(len(last), common, -1):
            path[i - 1][1][last[i - 1]] = finish(path.pop())
        path += [[False, {}] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1][last[i - 1]] = finish(path.pop())
    root = finish(path[0])
    size = [0] * len(states)  # finished states come after their targets' numbers
    for k, (arcs, final) in enumerate(states):
        size[k] = final + sum(size[t] for t in arcs.values())
    first, arcs_out = [], []
    for arcs, final in states:
        first.append(len(arcs_out) << 1 | final)
        skipped = int(final)
        for byte, target in arcs.items():
            arcs_out.append((byte, target, skipped))
            skipped += size[target]
    first.append(len(arcs_out) << 1)
    ids, at = [], [0]
    for word in words:
        ids += entries[word]
        at.append(len(ids))
    head = struct.pack("<5i", root, len(states), len(arcs_out), len(words), len(ids))
    return head + b"".join(struct.pack(f"<{len(x)}i", *x) for x in (first, [a[1] for a in arcs_out], [a[2] for a in arcs_out], at, ids)) + bytes(a[0] for a in arcs_out)


class Transducer:
    """Lookups in a compiled block, which is mapped and never unpacked."""

    def __init__(self, block: bytes) -> None:
        self.map = mmap.mmap(-1, max(1, len(block)))
        self.map.write(block)
        root, states, arcs, words, ids = struct.unpack_from("<5i", self.map, 0)
        view, at = memoryview(self.map), 20
        out = []
        for n in (states + 1, arcs, arcs, words + 1, ids):
            out.append(view[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.target, self.skipped, self.at, self.ids = out
        self.root = root
        self.first_of, self.target_of, self.skipped_of = (np.frombuffer(x, np.int32) for x in (self.first, self.target, self.skipped))
        self.key = np.repeat(np.arange(states, dtype=np.int64), np.diff(self.first_of >> 1)) * 256 + np.frombuffer(view[at : at + arcs], np.uint8)
        self.longest = self._depth()

    def _depth(self) -> int:
        """Bytes of the longest word: states come after those that their arcs lead to."""
        depth = [0] * (len(self.first) - 1)
        for k in range(len(depth)):
            depth[k] = max((depth[t] + 1 for t in self.target[self.first[k] >> 1 : self.first[k + 1] >> 1]), default=0)
        return depth[self.root]

    def lookup(self, word: bytes) -> list[int] | None:
        return self.lookup_all([word])[0]

    def lookup_all(self, words: list[bytes]) -> list[list[int] | None]:
        """Each word's ids, or None. All words walk the automaton together, a byte a step; (state, byte) leads to its arc by binary search."""
        out: list[list[int] | None] = [None] * len(words)
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        row = np.flatnonzero(size <= self.longest) if len(self.key) else np.zeros(0, np.int64)
        state, number = np.full(len(row), self.root, np.int64), np.zeros(len(row), np.int64)
        for k in range(self.longest + 1):
            ended = size[row] == k
            final = ended & (self.first_of[state] & 1 == 1)
            for i, m in zip(row[final].tolist(), number[final].tolist(), strict=True):
                out[i] = self.ids[self.at[m] : self.at[m + 1]].tolist()
            row, state, number = row[~ended], state[~ended], number[~ended]
            if not len(row):
                break
            wanted = state * 256 + data[begin[row] + k]
            arc = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            known = self.key[arc] == wanted
            row, arc = row[known], arc[known]
            state, number = self.target_of[arc].astype(np.int64), number[known] + self.skipped_of[arc]
        return out


class Merger:
    """Merges many short words at once: a row of symbols a word, and in each round every row's pair of lowest rank is joined.

    Symbols 0 to 255 are bytes, 256 to 511 bytes that end a word, 512 fills rows; joined ones follow.
    """

    FILL, WIDEST = 512, 40

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        number = {c: b for b, c in enumerate(LETTERS)}
        if rules.end:
            number |= {c + rules.end: 256 + b for b, c in enumerate(LETTERS)}
        symbols = itertools.count(self.FILL + 1)
        for a, b in rules.ranks:
            for part in (a, b, a + b):
                if part not in number:
                    number[part] = next(symbols)
        self.count = max(number.values()) + 1
        self.id = np.full(self.count + 1, -1, np.int64)
        for part, k in number.items():
            self.id[k] = rules.vocab.get(part, -1)
        self.none = len(rules.ranks)
        pairs = np.array([(number[a], number[b], number[a + b]) for a, b in rules.ranks], np.int64).reshape(-1, 3)
        key = pairs[:, 0] * self.count + pairs[:, 1]
        order = np.argsort(key)
        self.key, self.rank, self.joined = key[order], order.astype(np.int32), pairs[:, 2].astype(np.int32)
        self.single = np.full((513, 513), self.none, np.int32)
        few = np.flatnonzero((pairs[:, :2] < 512).all(axis=1))
        self.single[pairs[few, 0], pairs[few, 1]] = few
        self.last = 256 if rules.end else 0

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a.astype(np.int64) * self.count + b
        wanted[(a == self.FILL) | (b == self.FILL)] = -1
        if not len(self.key):
            return np.full(len(wanted), self.none, np.int32)
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.rank[at], self.none).astype(np.int32)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word of at most WIDEST bytes."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        width = int(size.max())
        at = np.arange(width)
        symbols = np.full((n, width), self.FILL, np.int32)
        symbols[at < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        symbols[np.arange(n), size - 1] += self.last
        rank = self.single[symbols[:, :-1], symbols[:, 1:]]
        row, out = np.arange(n), [[]] * n
        while True:
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), best] if rank.shape[1] else np.full(len(row), self.none)
            done = least == self.none
            if done.any():
                for i, ids in zip(row[done].tolist(), np.where(symbols[done] == self.FILL, -1, self.id[symbols[done]]).tolist(), strict=True):
                    out[i] = [x for x in ids if x >= 0]
                going = ~done
                row, symbols, rank, best, least = row[going], symbols[going], rank[going], best[going], least[going]
            if not len(row):
                return out
            each, at = np.arange(len(row)), np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, at + (at > best[:, None]), 1)
            symbols[each, best] = self.joined[least]
            rank = np.take_along_axis(rank, at[:-1] + (at[:-1] >= best[:, None]), 1)
            before, after = np.flatnonzero(best > 0), np.flatnonzero(best < rank.shape[1])
            rank[before, best[before] - 1] = self.ranks(symbols[before, best[before] - 1], symbols[before, best[before]])
            rank[after, best[after]] = self.ranks(symbols[after, best[after]], symbols[after, best[after] + 1])


class Encoder:
    def __init__(self, rules: Rules, block: bytes) -> None:
        self.rules, self.words, self.merger = rules, Transducer(block), Merger(rules)
        self.split = regex.compile(rules.pattern)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(rules.special, key=len, reverse=True))) if rules.special else None
        self.number = {i: str(i) for i in rules.token}
        #: By word (or special token's id): its ids as text, and what they decode to.
        self.ids: dict[str | int, str] = {i: str(i) for i in rules.special.values()}
        self.decoded: dict[str | int, str] = {i: s for s, i in rules.special.items()}

    def learn(self, words: set[str | int]) -> None:
        """Make sure that the cache holds all these words."""
        missing = [w for w in words if w not in self.ids]
        if len(self.ids) + len(missing) > CACHE:
            kept = words | set(self.rules.special.values())
            self.ids = {w: x for w, x in self.ids.items() if w in kept}
            self.decoded = {w: self.decoded[w] for w in self.ids}
        for lo in range(0, len(missing), 8192):
            self._learn(missing[lo : lo + 8192])

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        found = self.words.lookup_all(raw)
        short = [k for k, ids in enumerate(found) if ids is None and len(raw[k]) <= Merger.WIDEST]
        for k, ids in zip(short, self.merger.merge([raw[k] for k in short]) if short else [], strict=True):
            found[k] = ids
        number, token = self.number, self.rules.token
        for w, ids in zip(words, found, strict=True):
            if ids is None:
                ids = self.rules.merge(w)
            self.ids[w] = " ".join([number[i] for i in ids])
            self.decoded[w] = " ".join([token[i] for i in ids])

    def encode(self, text: str) -> tuple[str, int, str]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """Of each text its ids as text, their number, and the text that they decode to."""
        parts = [self._parts(t) for t in texts]
        self.learn(set().union(*parts))
        out = []
        for words in parts:
            ids = " ".join(filter(None, map(self.ids.__getitem__, words)))
            out.append((ids, ids.count(" ") + 1 if ids else 0, " ".join(filter(None, map(self.decoded.__getitem__, words)))))
        return out

    def _parts(self, text: str) -> list[str | int]:
        """A text's words, and the ids of its special tokens."""
        if self.special is None or not self.special.search(text):
            return self.split.findall(lower(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.split.findall(lower(text[at : m.start()])), self.rules.special[m[0]]]
            at = m.end()
        return out + self.split.findall(lower(text[at:]))


def frequent_words(docs: DataFrame, n: int = FREQUENT) -> list[str]:
    """The words of letters that occur most often in all documents: all that occur oftener than the count at which there would be more than n.

    The driver gets how many words have a count, from that of the n-th on, and at most n words.
    """
    words = F.explode(F.split(F.lower(F.col("text")), r"[^\p{L}]+")).alias("w")
    counts = materialise(docs.select(words).where("w <> ''").groupBy("w").count().where("count > 1"))
    level, total = 1, 0
    for row in counts.groupBy("count").agg(F.count("*").alias("words")).orderBy(F.desc("count")).limit(n).collect():
        total += row["words"]
        if total > n:
            level = row["count"]
            break
    return sorted(r["w"] for r in counts.where(F.col("count") > level).select("w").collect())


def lexicon(rules: Rules, words: list[str]) -> bytes:
    whole = regex.compile(rules.pattern)
    return compile_words({w.encode(): rules.merge(w) for w in words if w == lower(w) and whole.findall(w) == [w]})


_encoders: dict[str, Encoder] = {}


def worker_encoder(key: str, given) -> Encoder:
    """This worker's encoder with its cache, kept from task to task."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*given.value)
    return _encoders[key]


def encode(docs: DataFrame, tokenizer: str, words: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs without the text's column, and ids (their decimal numbers, joined by spaces), n_tokens and decoded.

    tokenizer: path of the tokenizer file, read by the driver. words: those to compile; by default the most frequent ones of docs.
    """
    spark = docs.sparkSession
    rules = Rules(tokenizer)
    block = lexicon(rules, frequent_words(docs.select(F.col(text_col).alias("text"))) if words is None else words)
    given = spark.sparkContext.broadcast((rules, block))
    key = hashlib.sha256(block).hexdigest()
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(key, given)
        for batch in batches:
            text = batch.column(len(kept))
            for lo, hi in slices(utf8(text)[1], STEP):
                rows = encoder.encode_all([t or "" for t in text.slice(lo, hi - lo).to_pylist()])
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], [*kept, "ids", "n_tokens", "decoded"])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("ids", "string").add("n_tokens", "long").add("decoded", "string")
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col)).mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    out = encode(docs.select("doc_id", "text"), tokenizer)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_tokenizer())
