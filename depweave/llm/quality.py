"""Quality classifier from weak labels.

Eight overlapping heuristics vote good, bad or abstain on every text.  Expectation-maximisation over the counts of
all vote patterns estimates how each votes given the true class; the posterior of its votes is a document's
soft label.  These train a logistic scorer over hashed words and hashed statistics, which scores every text, whole.

Votes are counted over all documents (at most 3^8 patterns reach the driver); the scorer is fitted on at most SAMPLE documents,
chosen by a hash of the id.  Null and empty texts vote as texts of no words do.  Repeated rows have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, mix64, slices, table, utf8
from ._words import WORD, Words, counted

SAMPLE = 8_000
SLOTS = 1 << 14
#: Statistic, bad where at least / at most (by sign), good where on the other side of the second bound; between them a heuristic abstains.
LABELLERS = [("signs", 0.15, 0.08), ("shouted", 0.25, 0.05), ("repeats", 0.15, 0.04), ("pipes", 0.03, 0.005), ("digits", 0.2, 0.05), ("long_words", 0.4, 0.2), ("few_words", 0.2, 0.03), ("same_words", 0.85, 0.6)]
STATS = [name for name, *_ in LABELLERS]


def statistics(words: Words) -> np.ndarray:
    """Shares from 0 to 1 by text: signs among bytes, words all in capitals, words equal to the one before, pipes, digits, words of 15 bytes or more, 1 / (words + 1), and how far the number of different words stays below what the length leads to expect."""
    n, doc = len(words.counts), words.doc
    size, count = np.maximum(np.diff(words.offsets), 1), np.maximum(words.counts, 1)
    data = words.raw
    chars = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[words.offsets]) / size
    per = lambda mask: np.bincount(doc, mask, n) / count
    length = words.ends - words.starts
    capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    shouted = (capitals[words.ends] - capitals[words.starts] == length) & (length > 1)
    h = words.hashes()
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    kinds, _, _ = counted(doc, h)
    distinct = np.bincount(kinds, minlength=n)
    # Repetition beyond what a text's length explains: against the square root of its words.
    same = np.where(words.counts > 0, 1 - np.minimum(1, distinct / np.maximum(1, 4 * np.sqrt(words.counts))), 0)
    return np.stack([chars(~WORD[data] & (data > 32)), per(shouted), per(again), chars(data == 124), chars((data >= 48) & (data <= 57)), per(length >= 15), 1 / (words.counts + 1), same], axis=1)


def votes(stats: np.ndarray) -> np.ndarray:
    """0 bad, 1 good, 2 abstains."""
    bad = np.array([b for _, b, _ in LABELLERS])
    good = np.array([g for *_, g in LABELLERS])
    return np.where(stats >= bad, 0, np.where(stats <= good, 1, 2))


POWERS = 3 ** np.arange(len(LABELLERS))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Accuracies by expectation-maximisation: P(vote | class) of each labeller, P(good), and P(good) of each pattern."""
    v = patterns[:, None] // POWERS[None, :] % 3
    tally = (v == 1).sum(1) - 2.0 * (v == 0).sum(1)  # a bad sign weighs more than a good one to begin with
    post = 1 / (1 + np.exp(-np.clip(tally, -20, 20)))
    table_, prior = np.zeros((2, len(LABELLERS), 3)), 0.5
    for _ in range(rounds):
        for c, p in enumerate((1 - post, post)):
            for k in range(3):
                table_[c, :, k] = ((v == k) * (p * counts)[:, None]).sum(0) + 0.5
            table_[c] /= table_[c].sum(1, keepdims=True)
        prior = float(np.clip((post * counts).sum() / max(1, counts.sum()), 0.01, 0.99))
        log = [np.log(table_[c])[np.arange(len(LABELLERS))[None, :], v].sum(1) + np.log(q) for c, q in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return table_, prior, post


def hashed(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value) of hashed words (scaled to length one by text) and of binned statistics; and the statistics."""
    doc, h, times = counted(words.doc, words.hashes())
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(doc, value**2, len(words.counts)))
    slot = (mix64(h) >> np.uint64(50)).astype(np.int64)
    stats = statistics(words)
    n, m = stats.shape
    bins = np.minimum(9, np.sqrt(stats) * 10).astype(np.int64)
    own = (mix64((np.arange(m, dtype=np.uint64)[None, :] << np.uint64(8)) + bins.astype(np.uint64) + np.uint64(1)) >> np.uint64(50)).astype(np.int64)
    return np.concatenate([doc, np.repeat(np.arange(n), m)]), np.concatenate([slot, own.ravel()]), np.concatenate([value / np.maximum(norm, 1e-9)[doc], np.ones(n * m)]), stats


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    data, offsets = utf8(batch.column("text"))
    for lo, hi in slices(offsets, 2 << 20):
        for at in range(lo, hi, 60_000):
            to = min(hi, at + 60_000)
            yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in _parts(batch):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(votes(statistics(words)) @ POWERS, pa.int32())], ["doc_id", "pattern"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in _parts(batch):
            doc, slot, value, _ = hashed(words)
            order = np.argsort(doc, kind="stable")
            at = np.searchsorted(doc[order], np.arange(hi - lo + 1))
            slot, value = slot[order].astype(np.int16), value[order].astype(np.float32)
            cut = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("pattern").slice(lo, hi - lo), cut(slot), cut(value)], ["pattern", "slots", "value"])


def train(doc: np.ndarray, slot: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer, the last for the constant, by full gradients with Adam."""
    w = np.zeros(SLOTS + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[slot] * value, len(y)) + w[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g = np.append(np.bincount(slot, r[doc] * value, SLOTS), r.sum()) / max(1, len(y)) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def _scores(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in _parts(batch):
                doc, slot, value, _ = hashed(words)
                z = np.bincount(doc, weights[slot] * value, hi - lo) + weights[-1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and good (1 from 0.5 on)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    voted = materialise(docs.mapInArrow(_patterns, "doc_id long, pattern int"))
    counts = voted.groupBy("pattern").count().orderBy("pattern").toPandas()
    _, _, post = estimate(counts["pattern"].to_numpy(np.int64), counts["count"].to_numpy(float))
    label = dict(zip(counts["pattern"], post, strict=True))
    chosen = materialise(voted.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(sample))
    rows = docs.join(F.broadcast(chosen), "doc_id").select("pattern", "text").mapInArrow(_sampled, "pattern int, slots binary, value binary").toPandas()
    slots = [np.frombuffer(x, np.int16).astype(np.int64) for x in rows["slots"]]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in slots])
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    weights = train(doc, flat(slots, np.int64), flat([np.frombuffer(x, np.float32) for x in rows["value"]], np.float32), np.array([label[p] for p in rows["pattern"]]))
    return docs.mapInArrow(_scores(weights), "doc_id long, score double").withColumn("good", (F.col("score") >= 0.5).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
