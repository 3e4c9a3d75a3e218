"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words; its weight in a text is its count times 4 + ln(1 + N / df), smoothed so that copies are found in a group that
makes up much of the corpus too, whose shared shingles are then common.  Document frequencies are
counted over all documents in a table of 2^18 slots by the shingle's hash (a shingle takes the count of its slot), so what is
broadcast has a fixed size.  48 samples a text are cut into 12 bands of 4; documents that share a band are candidates, and a
link is a pair whose weighted Jaccard similarity over whole texts is at least 0.8.

Texts of equal weighted shingles are one representative first, however many they are.  In every band's bucket members are
compared with a leader, which settles groups of copies; no member is dropped, however large its bucket.  What is left, members of
different components in one bucket, is bounded before it is compared: shingles that at most RARE of these members hold are listed, and
members that share one are compared.  All others share nothing but the rest of their weight, s of w, and two of them reach the
similarity t only if each is at most s (1 + t) / t - w heavy; who has no such partner is done, and the others are compared with
STEPS times as many leaders each round (with all at once, if they are few), until every pair of a bucket is compared, joined by links or ruled out by its bound.
Classes are the connected components of the links; the row of the smallest doc_id of a class (nulls last) names it and stays.

Null, empty and wordless texts have no shingles and are alone. Texts of one to four words have one shingle, all
their words. Repeated rows are in one class, of which one row is kept; rows that share a doc_id are rows of their own, and
rows without one take part (the class of such rows alone has a null class_id). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hot_join, materialise, mix64, numbered, slices, table, utf8
from ._words import Words, counted
from .components import merge

WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS = 12, 4
SLOTS = 1 << 18
SMOOTHING = 4.0
#: Shingles that so many members hold at most are listed with them.
RARE = 8
#: Pairs for each member that are compared in one round, all members leading, instead of several rounds.
AT_ONCE = 16
#: Times the leaders of one round that the next one has. A round costs some 40 stages, however few its pairs.
STEPS = 16
#: Most members whose rows are picked by a bitmap (of 32 MB then).
MOST_MARKS = 1 << 23
#: Bytes of texts that are worked on at once.
STEP = 2 << 20
_SLOT = np.uint64(SLOTS - 1)


def _parts(batch: pa.RecordBatch, most: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a batch with their distinct shingles (text, 48-bit hash, count)."""
    data, offsets = utf8(batch.column("text"))
    for lo, hi in slices(offsets, most):
        for at in range(lo, hi, 60_000):
            to = min(hi, at + 60_000)
            words = Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            yield at, to, *counted(*words.shingles(WIDTH))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, _, _, h, _ in _parts(batch):
            total += np.bincount((h & _SLOT).astype(np.int64), minlength=SLOTS)
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total[slot], pa.int64())], ["slot", "n"])


def idf_table(docs: DataFrame) -> np.ndarray:
    """4 + ln(1 + N / df) by slot; N and df over all documents. The driver gets one row per slot at most."""
    counts = docs.mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.ones(SLOTS)
    df[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    return (SMOOTHING + np.log1p(docs.count() / df)).astype(np.float32)


class Sampler:
    """Tables of the variates r and c of Gamma(2, 1) and b of [0, 1) that a shingle draws for each sample."""

    def __init__(self, samples: int = BANDS * ROWS) -> None:
        rng = np.random.default_rng(20_101)
        self.r = rng.gamma(2, 1, 65536).astype(np.float32)
        self.over_r = (1 / self.r).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, 65536)).astype(np.float32)
        self.b = rng.random(65536, np.float32)
        self.keys = mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)

    def samples(self, doc: np.ndarray, h: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each key, texts and the hash of their sample (shingle, t)."""
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        lengths = np.diff(np.append(first, len(doc)))
        spread, ln_w = mix64(h), np.log(weight).astype(np.float32)
        for key in self.keys:
            draw = spread * key
            draw ^= draw >> np.uint64(29)
            r = (draw >> np.uint64(48)).astype(np.int64)
            t = np.floor(ln_w * self.over_r[r] + self.b[((draw >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)])
            ln_a = self.ln_c[((draw >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)] - self.r[r] * (t - self.b[((draw >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)] + 1)
            least = np.repeat(np.minimum.reduceat(ln_a, first), lengths)
            hit = np.flatnonzero(ln_a == least)
            hit = hit[np.concatenate([[True], doc[hit][1:] != doc[hit][:-1]])]
            yield doc[first], mix64(h[hit] + t[hit].astype(np.int64).view(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


SIGNED = "doc_id long, c1 long, c2 long, weight double, bands array<long>"


def _sign(idf: np.ndarray):
    sampler = Sampler()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, doc, h, times in _parts(batch):
                n = hi - lo
                content, bands = np.zeros((2, n), np.uint64), np.zeros((n, BANDS), np.uint64)
                some, total = np.zeros(n, bool), np.zeros(n)
                if len(doc):
                    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    some[doc[first]] = True
                    for k in range(2):
                        content[k, doc[first]] = np.add.reduceat(mix64(h * np.uint64(2 * k + 3) + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
                    weight = times * idf[(h & _SLOT).astype(np.int64)]
                    total[doc[first]] = np.add.reduceat(weight, first, dtype=float)
                    for k, (docs, hit) in enumerate(sampler.samples(doc, h, weight)):
                        bands[docs, k // ROWS] = mix64(bands[docs, k // ROWS] * np.uint64(0x8EBC6AF09C88C6E3) + hit)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
                lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(~some))
                columns = [batch.column("doc_id").slice(lo, n), *[pa.array(c.view(np.int64), mask=~some) for c in content], pa.array(total), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "c1", "c2", "weight", "bands"])

    return run


def _bits(ids: pa.Array, width: int) -> np.ndarray:
    return mix64(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - width)


def _marks(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bitmap of 16 to 32 bits for each of n ids (doc_id), in words of 64, and the logarithm of its size: a bit is set for each id, and few others are by chance."""
    width = max(10, (16 * n).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bits(batch.column("doc_id"), width))
            word, mask = bits >> np.uint64(6), np.uint64(1) << (bits & np.uint64(63))
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(bits) else np.zeros(0, int)
            mask = np.bitwise_or.reduceat(mask, first) if len(first) else mask
            yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    found = ids.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(1 << (width - 6), np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return out, width


def _vectors(given=None, width: int = 0):
    """Sorted hashes of a text's shingles, and their counts unless all are one; given: marks of the rows that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if given is not None:
                bits = _bits(batch.column("doc_id"), width)
                batch = batch.filter(pa.array((given.value[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) > 0))
            for lo, hi, doc, h, times in _parts(batch):
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                several = np.add.reduceat(np.append(times > 1, False), at[:-1]) * (at[1:] > at[:-1]) if hi > lo else []
                hashes = pa.array([h[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
                counts = pa.array([times[i:j].astype(np.uint32).tobytes() if k else None for i, j, k in zip(at[:-1], at[1:], several, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), hashes, counts], ["doc_id", "h", "n"])

    return run


def vectors_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, h, n) of the rows of docs with these ids, and of few others. Texts aren't shuffled, unless the ids are too many for a bitmap."""
    ids = materialise(ids.select("doc_id").distinct())
    n, schema = ids.count(), "doc_id long, h binary, n binary"
    if n > MOST_MARKS:
        return materialise(docs.join(ids, "doc_id", "left_semi").mapInArrow(_vectors(), schema))
    marks, width = _marks(ids, n)
    return materialise(docs.mapInArrow(_vectors(docs.sparkSession.sparkContext.broadcast(marks), width), schema))


def _vector(h: bytes, n: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.frombuffer(h, np.uint64)
    return hashes, np.frombuffer(n, np.uint32) if n is not None else np.ones(len(hashes), np.uint32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Weighted Jaccard of (sorted hashes, counts)."""
    weights = [n * idf[(h & _SLOT).astype(np.int64)] for h, n in (a, b)]
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(weights[0][i], weights[1][j]).sum(dtype=float))
    total = float(weights[0].sum(dtype=float) + weights[1].sum(dtype=float))
    return both / (total - both) if total > both else 0.0 if not total else 1.0


def _verify(idf: np.ndarray, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("ha", "na", "hb", "nb")]
            like = [similarity(_vector(ha, na), _vector(hb, nb), idf) >= similar for ha, na, hb, nb in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(like, pa.bool_())], ["a", "b", "similar"])

    return run


HOLDERS = "h long, n long, held array<struct<rep: long, label: long, total: double, weight: double>>"


def _holders(idf: np.ndarray):
    """Of members (rep, label, weight, h, n): each shingle, how many of a batch hold it, and which if they are RARE at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_vector(h, n) for h, n in zip(batch.column("h").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            if not pairs:
                continue
            member = np.repeat(np.arange(len(pairs)), [len(h) for h, _ in pairs])
            h, times = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(h, kind="stable")
            h, member = h[order], member[order]
            weight = times[order] * idf[(h & _SLOT).astype(np.int64)].astype(float)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            n = np.diff(np.append(first, len(h)))
            few = n <= RARE
            listed = np.repeat(few, n)
            mine = [batch.column(c).to_numpy(zero_copy_only=False)[member[listed]] for c in ("rep", "label", "weight")]
            struct = pa.StructArray.from_arrays([*map(pa.array, mine), pa.array(weight[listed])], ["rep", "label", "total", "weight"])
            offsets = pa.array(np.append(0, np.cumsum(n * few)), pa.int32())
            held = pa.ListArray.from_arrays(offsets, struct, mask=pa.array(~few))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(n), held], ["h", "n", "held"])

    return run


def _bounded(now: DataFrame, vectors: DataFrame, idf: np.ndarray, similar: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of members that share a rare shingle, and the members that may be like another one of their bucket without one.

    now: band, key, rep, weight, cap, label of buckets of several labels. A pair without a common rare shingle is ruled out
    exactly if one of it is heavier than the other's new cap, see the module.
    """
    alive = materialise(now.select("rep", "label", "weight").distinct())
    held = alive.join(vectors.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "label", "weight", "h", "n").mapInArrow(_holders(idf), HOLDERS)
    held = held.groupBy("h").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("held")).alias("held")).where(F.col("n") <= RARE)
    held = materialise(held.select("n", "held"))
    rare = held.select(F.explode("held").alias("x")).groupBy("x.rep").agg(F.sum("x.weight").alias("rare"))
    partners = lambda x: F.transform(F.filter("held", lambda y: (y["rep"] > x["rep"]) & (y["label"] != x["label"]) & (F.least(x["total"], y["total"]) >= similar * F.greatest(x["total"], y["total"]))), lambda y: F.struct(y["rep"].alias("a"), x["rep"].alias("b")))
    close = held.where("n > 1").select(F.explode(F.flatten(F.transform("held", partners))).alias("p")).select("p.a", "p.b")
    # A little more than the bound, for the rounding of sums.
    cap = ((F.col("weight") - F.coalesce("rare", F.lit(0.0))) * ((1 + similar) / similar) - F.col("weight")) * (1 + 1e-6)
    caps = materialise(alive.join(rare, "rep", "left").select("rep", cap.alias("cap")).where(F.col("cap") >= similar * F.col("weight") * (1 - 1e-6)))
    return close, now.drop("cap", "label").join(caps, "rep").select("band", "key", "rep", "weight", "cap")


def _mixed(members: DataFrame) -> DataFrame:
    """Buckets (band, key, m, first) whose members have several labels, with their size and first leader."""
    order = F.when(F.col("band") % 2 == 0, F.xxhash64("rep")).otherwise(F.xxhash64("rep", F.lit(1)))
    buckets = members.groupBy("band", "key").agg(F.min(F.struct(order.alias("o"), "rep")).alias("first"), F.count("*").alias("m"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1")
    return materialise(buckets.select("band", "key", "m", F.col("first.rep").alias("first")))


def _wanted(members: DataFrame, leaders_each: int) -> tuple[DataFrame, DataFrame, bool]:
    """Members of buckets of several labels, pairs (a, b) of them and their buckets' leaders of other labels within the caps, and whether all members lead.

    members: band, key, rep, weight, cap, label. Leaders are the first in order and about as many more as asked for; those of a
    round lead in the next one too. A bucket of one label has nothing left to find out.
    """
    buckets = _mixed(members)
    most = buckets.agg(F.max("m")).first()[0] or 0
    draw = F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(1 << 20)) / float(1 << 20)
    chosen = (F.col("rep") == F.col("first")) | (draw * F.col("m") < leaders_each - 1)
    inside = materialise(members.join(buckets, ["band", "key"]).select("band", "key", "rep", "weight", "cap", "label", chosen.alias("leads")))
    leaders = inside.where("leads").select("band", "key", F.col("rep").alias("leader"), F.col("weight").alias("other_weight"), F.col("cap").alias("other_cap"), F.col("label").alias("other"))
    pairs = inside.join(leaders, ["band", "key"]).where("label != other and weight <= other_cap and other_weight <= cap")
    return inside.drop("leads"), pairs.select(F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b")), leaders_each > most


def _few_pairs(members: DataFrame) -> bool:
    """Whether the pairs of members of one bucket but different labels are AT_ONCE for each member at most, within or without the caps."""
    each = members.groupBy("band", "key", "label").agg(F.count("*").alias("m")).groupBy("band", "key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"))
    row = each.agg(F.sum("m").alias("members"), F.sum(F.col("m") * F.col("m") - F.col("same")).alias("pairs")).first()
    return (row["pairs"] or 0) <= 2 * AT_ONCE * (row["members"] or 0)


def labels(docs: DataFrame, members: DataFrame, idf: np.ndarray, similar: float) -> DataFrame:
    """(node, label): components of the links between representatives that share a band; only nodes with links. members: band, key, rep, weight."""
    found, known, leaders_each, all_lead = docs.sparkSession.createDataFrame([], "node long, label long"), None, 1, False
    members = members.withColumn("cap", F.col("weight") * ((1 + 1e-6) / similar))
    vectors = close = None

    def compare(pairs: DataFrame) -> None:
        nonlocal found, known
        pairs = pairs.distinct()
        pairs = materialise(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return
        near = vectors
        if known is not None:  # in later rounds few members are compared
            near = vectors.join(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi")
        sides = [near.select(F.col("doc_id").alias(x), F.col("h").alias(f"h{x}"), F.col("n").alias(f"n{x}")) for x in "ab"]
        checked = materialise(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ha", "na", "hb", "nb").mapInArrow(_verify(idf, similar), "a long, b long, similar boolean"))
        known = checked if known is None else known.union(checked)
        links = checked.where("similar").select("a", "b")
        if not links.isEmpty():
            found = merge(found, links)

    def labelled() -> DataFrame:
        return members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    while not all_lead:
        members, pairs, all_lead = _wanted(labelled(), leaders_each)
        members = members.drop("label")
        if vectors is None:
            vectors = vectors_of(docs, members.select(F.col("rep").alias("doc_id")))
        compare(pairs if close is None else pairs.union(close))
        close = None
        if leaders_each == 1 and not all_lead:
            now = labelled().join(_mixed(labelled()).select("band", "key"), ["band", "key"], "left_semi")
            close, members = _bounded(materialise(now), vectors, idf, similar)
        if not all_lead and _few_pairs(labelled()):
            leaders_each = 1 << 40
        leaders_each *= STEPS
    return found


def _classes(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """_row, _class, class_size and kept of texts (doc_id, unique and not null, and text); _class is the least _row of a class."""
    idf = idf_table(texts)
    signed = materialise(texts.mapInArrow(_sign(idf), SIGNED))
    reps = materialise(signed.where("c1 is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("weight").alias("weight"), F.min("bands").alias("bands")))
    found = labels(texts, reps.select("rep", "weight", F.posexplode("bands").alias("band", "key")), idf, similar)
    label = reps.select("c1", "c2", "rep", "copies").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", "copies", F.coalesce("label", "rep").alias("label"))
    label = materialise(label)
    classes = materialise(label.groupBy("label").agg(F.sum("copies").alias("class_size"), F.count("*").alias("texts")))
    texts_of = hot_join(label, classes, ["label"], "texts", label.count()).select("c1", "c2", "copies", "label", "class_size")
    own = hot_join(signed.select("doc_id", "c1", "c2"), materialise(texts_of), ["c1", "c2"], "copies", signed.count())
    alone = F.col("label").isNull()
    return own.select(F.col("doc_id").alias("_row"), F.coalesce("label", "doc_id").alias("_class"), F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"), (alone | (F.col("doc_id") == F.col("label"))).alias("kept"))


def classes(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, kept."""
    rows, _, unique = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), nulls_first=False)
    own = _classes(rows.select(F.col("_row").alias("doc_id"), "text"), similar)
    if unique:
        return own.select(F.col("_row").alias("doc_id"), F.col("_class").alias("class_id"), "class_size", "kept")
    own = materialise(own)
    ids = rows.select("_row", "doc_id")
    heads = own.where(F.col("_row") == F.col("_class")).join(ids, "_row").select("_class", F.col("doc_id").alias("class_id"), F.col("class_size").alias("n"))
    return hot_join(own, materialise(heads), ["_class"], "n", own.count()).join(ids, "_row").select("doc_id", "class_id", "class_size", "kept")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each class one row, with the smallest doc_id; the columns of docs."""
    rows, row, _ = numbered(docs, nulls_first=False)
    dropped = _classes(rows.select(F.col(row).alias("doc_id"), "text")).where(~F.col("kept")).select(F.col("_row").alias(row))
    return rows.join(dropped, row, "left_anti").select([f"`{c}`" for c in docs.columns])
