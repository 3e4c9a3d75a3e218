"""Language identification by a byte convolutional network, trained in numpy.

Bytes have vectors of 8 numbers; filters of widths 2, 3 and 4, 16 of each, slide over a window of 192 bytes, are rectified and
max-pooled, and a softmax layer gives the languages.  Every window of a text is scored; the mean of the windows'
probabilities, by their bytes, decides.

Learned from at most SAMPLE documents of each language that are not held out (crc32 of the id as text, mod 5, is not 0), chosen by a
hash of the id, so that a rare language is learned too; up to EACH windows, spread over the text, are taken of one.  A null text, or one without any letter, is `und` with score 1; so is
every text if there is nothing to learn from, with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, table, utf8

SAMPLE, EACH = 1_500, 4
#: Windows of many texts that are scored together.
TOGETHER = 4096
WINDOW, VECTOR, WIDTHS, FILTERS = 192, 8, (2, 3, 4), 16
PAD = max(WIDTHS) - 1
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Network:
    def __init__(self, languages: list[str], seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        n, f = max(WIDTHS) * VECTOR, len(WIDTHS) * FILTERS
        self.languages = languages
        # A narrower filter is one of full width whose last rows stay zero.
        self.mask = np.repeat(np.concatenate([np.arange(n)[:, None] < w * VECTOR for w in WIDTHS], axis=1), FILTERS, axis=1).astype(np.float32)
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        self.p = {"e": draw(256, VECTOR, by=0.5), "w": draw(n, f, by=0.2) * self.mask, "b": np.zeros(f, np.float32), "v": draw(f, len(languages), by=0.2), "c": np.zeros(len(languages), np.float32)}

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, WINDOW, 4 * VECTOR) from (windows, WINDOW + PAD) bytes."""
        x = self.p["e"][windows]
        return np.concatenate([x[:, j : j + WINDOW] for j in range(PAD + 1)], axis=2)

    def fit(self, windows: np.ndarray, y: np.ndarray, steps: int = 900, batch: int = 64, rate: float = 0.004) -> Network:
        rng = np.random.default_rng(1)
        share = np.bincount(y, minlength=len(self.languages)) / max(1, len(y))
        weight = (1 / np.sqrt(np.maximum(share, 1e-3))).astype(np.float32)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        rows = np.arange(batch)[:, None]
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(y), batch)
            x, target = windows[pick], y[pick]
            columns = self._columns(x)
            z = columns @ self.p["w"] + self.p["b"]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
            hidden = np.maximum(top, 0)
            d = softmax(hidden @ self.p["v"] + self.p["c"])
            d[np.arange(batch), target] -= 1
            d *= (weight[target] / weight[target].sum())[:, None]
            g = {"v": hidden.T @ d, "c": d.sum(0)}
            dz = (d @ self.p["v"].T) * (top > 0)
            seen = columns[rows, at]  # what each filter's maximum saw
            g["w"] = np.einsum("bf,bfk->kf", dz, seen) * self.mask
            g["b"] = dz.sum(0)
            back = (dz[:, :, None] * self.p["w"].T[None]).reshape(batch, -1, PAD + 1, VECTOR)
            g["e"] = np.zeros_like(self.p["e"])
            np.add.at(g["e"], x[rows[:, :, None], at[:, :, None] + np.arange(PAD + 1)], back)
            step = rate * min(1, 2 * (1 - t / (steps + 1)))
            for k, (a, b) in m.items():
                a += 0.1 * (g[k] - a)
                b += 0.01 * (g[k] ** 2 - b)
                self.p[k] -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-7)
        return self

    def predict(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(windows), 128):
            z = (self._columns(windows[lo : lo + 128]).reshape(-1, (PAD + 1) * VECTOR) @ self.p["w"]).reshape(-1, WINDOW, len(WIDTHS) * FILTERS)
            out.append(softmax(np.maximum(z.max(axis=1) + self.p["b"], 0) @ self.p["v"] + self.p["c"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, start: int, end: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Windows of data[start:end], zeros after its end."""
    n = end - start
    starts = np.arange(0, n, WINDOW) if starts is None else starts
    padded = np.zeros(n + WINDOW + PAD, np.uint8)
    padded[:n] = data[start:end]
    # Bytes after a window's end belong to the next one.
    out = padded[starts[:, None] + np.arange(WINDOW + PAD)]
    out[:, WINDOW:] = 0
    return out


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        langs, parts = [], []
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            n = int(offsets[i + 1] - offsets[i])
            if n:
                starts = np.unique(np.linspace(0, max(0, n - WINDOW), EACH).astype(int))
                w = windows_of(data, offsets[i], offsets[i + 1], starts)
                langs += [lang] * len(w)
                parts += [x.tobytes() for x in w]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "w"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """docs: doc_id, text, lang."""
    ids = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "lang").distinct()
    # Spark limits the groups of a rank before it shuffles, so a language's share of a task is `sample` rows.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id"))
    chosen = materialise(ids.withColumn("_place", place).where(F.col("_place") <= sample).select("doc_id", "lang"))
    rows = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").mapInArrow(_training, "lang string, w binary").orderBy("lang", "w").toPandas()
    languages = sorted(set(rows["lang"]))
    net = Network(languages)
    if len(rows):
        windows = np.frombuffer(b"".join(rows["w"]), np.uint8).reshape(len(rows), -1)
        net.fit(windows, np.searchsorted(languages, rows["lang"].to_numpy(str)))
    return net


def _scored(net: Network, data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Mean probabilities of each span (start, end) of data, over its bytes; windows of many spans are scored together."""
    total, held, owner, weight = np.zeros((len(spans), len(net.languages))), [], [], []

    def score() -> None:
        if held:
            p = net.predict(np.concatenate(held)).astype(float)
            np.add.at(total, np.concatenate(owner), p * np.concatenate(weight)[:, None])
        held.clear(), owner.clear(), weight.clear()

    waiting = 0
    for k, (start, end) in enumerate(spans):
        for lo in range(start, end, TOGETHER * WINDOW):
            hi = min(end, lo + TOGETHER * WINDOW)
            held.append(windows_of(data, lo, hi))
            owner.append(np.full(len(held[-1]), k))
            weight.append(np.minimum(WINDOW, hi - lo - np.arange(len(held[-1])) * WINDOW))
            waiting += len(held[-1])
            if waiting >= TOGETHER:
                score()
                waiting = 0
    score()
    return total / np.maximum(spans[:, 1] - spans[:, 0], 1)[:, None]


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred, score from doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            known = np.array([t.is_valid and LETTER.search(t.as_py()) is not None for t in batch.column("text")], bool)
            langs, scores = np.full(len(known), "und", object), np.where(known, 0.0, 1.0)
            if net.languages and known.any():
                mean = _scored(net, data, np.stack([offsets[:-1], offsets[1:]], axis=1)[known])
                langs[known] = np.array(net.languages, object)[mean.argmax(axis=1)]
                scores[known] = np.minimum(1.0, mean.max(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
