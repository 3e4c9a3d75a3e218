"""Toxicity: gradient-boosted trees over dense features of the text, calibrated isotonically.

Features: densities of lexicon words in three strengths and their largest strength, lexicon words near
second-person words, capitals, shouted words, punctuation, exclamation marks, and the rate of obfuscated words
(letters mixed with digits or signs, runs of one letter, lexicon words after undoing look-alikes).
The lexicon is a fixed list of insults and, learned from labelled texts, the words and stems (4 to 8 leading bytes) that
toxic texts hold far oftener than others.

Labels are learned from at most SAMPLE labelled documents, chosen by a hash of the id, of those not held out
(crc32 of the id as text, mod 4, is not 2).  Trees are fitted on all of these; the calibration is fitted on scores that the trees of five folds give
to the fifth they haven't seen.  The lexicon is learned from all of them before, so its part of the calibration isn't out of sample.
Null and empty texts have all features 0 and a score as any other.  A document with several labels counts as toxic if one says so;
null labels and null ids are not learned from.  Without any label of both kinds every score is the fixed lexicon's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._boosting import Boosted, Isotonic
from ._common import materialise, slices, table, utf8
from ._words import FOLD, WORD, Words

#: Most labelled documents that are learned from.
SAMPLE = 12_000
THRESHOLD = 0.3
STEMS = (4, 5, 6, 7, 8)

#: Insults in several languages, second-person words.
INSULTS = """
idiot idiots moron morons stupid dumb loser losers clown clowns trash garbage scum pathetic worthless disgusting imbecile jerk fool fools filth vermin
bastard bitch asshole crap shit fuck fucking damn retard ugly creep freak pig pigs coward liar disgrace
dummkopf trottel vollidiot arschloch abschaum scheisse scheiße drecksau versager widerlich
connard salaud imbécile abruti crétin ordure salope débile pourriture minable
idiota estúpido imbécil basura escoria cabrón pendejo payaso asqueroso inútil
""".split()
SECOND = "you your yours yourself u ur youre du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split()

#: Look-alikes: what stands for a letter in obfuscated words.
_ALIKE = FOLD.copy()
for _a, _b in zip("013457@$!", "oieastasi", strict=True):
    _ALIKE[ord(_a)] = ord(_b)
NAMES = ["lexicon", "strong", "fixed", "strongest", "second", "near_second", "capitals", "shouted", "punctuation", "exclaimed", "mixed", "stretched", "undone", "ln_words", "n_strong"]


def words_hashed(words: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array([" ".join(words)]))
    return Words(data, offsets).hashes()


_FIXED, _SECOND = np.sort(words_hashed(INSULTS)), np.sort(words_hashed(SECOND))


def _in(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


class Lexicon:
    """Hashes of words and stems with how strongly they speak for a toxic text."""

    def __init__(self, keys: np.ndarray, strengths: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.strengths = keys[order], strengths[order]

    def strength(self, words: Words) -> np.ndarray:
        out = np.zeros(len(words.starts))
        for prefix in (0, *STEMS):
            h = words.hashes(prefix)
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                out = np.maximum(out, np.where(self.keys[at] == h, self.strengths[at], 0))
        return out


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    words = Words(data, offsets)
    n = len(offsets) - 1
    doc, whole = words.doc, words.hashes()
    count = np.maximum(words.counts, 1)
    per_doc = lambda w: np.bincount(doc, w, n) / count
    strength = lexicon.strength(words)
    fixed = _in(whole, _FIXED)
    strength = np.maximum(strength, np.where(fixed, 2.0, 0))
    second, hit = _in(whole, _SECOND), strength >= 1
    near = np.zeros(len(doc), bool)
    for d in (1, 2, 3):
        if len(doc) > d:
            same = doc[d:] == doc[:-d]
            near[d:] |= same & hit[d:] & second[:-d]
            near[:-d] |= same & hit[:-d] & second[d:]
    strongest = np.zeros(n)
    np.maximum.at(strongest, doc, strength)
    # Characters.
    size = np.maximum(np.diff(offsets), 1)
    upto = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / size
    capital = (data >= 65) & (data <= 90)
    signs = ~WORD[data] & (data > 32)
    # Words: capitals only, letters mixed with digits, a letter three times in a row.
    length = words.ends - words.starts
    if len(doc):
        total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([words.starts, words.ends])], axis=0)[0]
        digit = (data >= 48) & (data <= 57)
        n_capital, n_digit = total(capital), total(digit)
        run = np.zeros(len(data), bool)
        if len(data) > 2:
            run[2:] = (words.folded[2:] == words.folded[1:-1]) & (words.folded[1:-1] == words.folded[:-2]) & ~digit[2:]
        shouted = (n_capital == length) & (length > 2)
        mixed = (n_digit > 0) & (n_digit < length) & (n_digit * 2 <= length)
        stretched = total(run) > 0
        undone = _in(words.hashes(folded=_ALIKE[words.raw]), _FIXED) & ~fixed
    else:
        shouted = mixed = stretched = undone = np.zeros(0, bool)
    return np.stack([per_doc(hit), per_doc(strength >= 2), per_doc(fixed), strongest, per_doc(second), per_doc(near), upto(capital), per_doc(shouted), upto(signs), upto(data == 33), per_doc(mixed), per_doc(stretched), per_doc(undone), np.log1p(words.counts), np.log1p(np.bincount(doc, strength >= 2, n))], axis=1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, y of at most `sample` documents."""
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    chosen = materialise(y.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample))
    return materialise(docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """All words and stems (the sample bounds them) of at least 2 % of toxic texts (at least 4 texts) that they hold at least e times as often, by a cautious estimate."""

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            y = np.array(batch.column("y").to_pylist())
            for lo, hi in slices(offsets, 2 << 20):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                pairs = np.concatenate([np.unique(np.stack([words.doc.astype(np.uint64), words.hashes(p)], axis=1), axis=0) for p in (0, *STEMS)])
                pairs = np.unique(pairs, axis=0)
                key, at = np.unique(pairs[:, 1], return_inverse=True)
                toxic = np.bincount(at, y[lo:hi][pairs[:, 0].astype(int)] > 0, len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64) - toxic)], ["key", "p", "n"])

    totals = rows.agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).first()
    toxic, clean = totals["t"] or 0, totals["c"] or 0
    counts = rows.mapInArrow(presence, "key long, p long, n long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    least = F.greatest(F.col("p") - F.sqrt("p"), F.lit(0)) + 0.5
    ratio = F.ln(least / (toxic + 1.0)) - F.ln((F.col("n") + F.sqrt("n") + 0.5) / (clean + 1.0))
    found = counts.where(F.col("p") >= max(4, 0.02 * toxic)).withColumn("s", ratio).where("s >= 1").orderBy("key").toPandas()
    return Lexicon(found["key"].to_numpy(np.int64).view(np.uint64), found["s"].to_numpy(float))


def _features_of(lexicon: Lexicon, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets, 2 << 20):
                x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in keep] + [pa.array(c) for c in x.T], keep + NAMES)

    return run


class Model:
    def __init__(self, lexicon: Lexicon, trees: Boosted | None, calibration: Isotonic | None) -> None:
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.clip(x[:, NAMES.index("fixed")] * 30, 0, 1)
        return np.clip(self.calibration.predict(self.trees.score(x)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, sample)
    lexicon = learn_lexicon(rows)
    numbers = ", ".join(f"{c} double" for c in NAMES)
    data = rows.mapInArrow(_features_of(lexicon, ["doc_id", "y"]), f"doc_id long, y int, {numbers}").orderBy("doc_id").toPandas()
    x, y = data[NAMES].to_numpy(float), (data["y"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, None, None)
    fold = np.arange(len(y)) % 5
    out = np.zeros(len(y))
    for k in range(5):
        out[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).score(x[fold == k])
    return Model(lexicon, Boosted().fit(x, y), Isotonic().fit(out, y))


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs (with `text`) and a column of scores; the other columns go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets, 2 << 20):
                s = model.score(features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], model.lexicon))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(s)], [*batch.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject; the columns of docs."""
    model = fit(docs.select("doc_id", "text"), labels)
    return scored(docs, model, "_toxicity").where(F.col("_toxicity") < THRESHOLD).drop("_toxicity")
