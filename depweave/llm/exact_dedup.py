"""Exact copies by an extendible-hash index on shared files.

The index maps the 64-bit hash of a normalised text to the row that stays.  Its directory starts with one
bucket and doubles until no bucket holds more distinct keys than its capacity; a bucket is a range of keys.
Each range has one owner task, which reads its texts in key order, chains different texts of
equal hash by comparing their bytes, and writes its part of the index.  Before texts are dealt to owners, every
task collapses the copies it sees, so a text that a third of all rows share arrives once per task and window.
Documents find their entry by hash and digest; only (doc_id, hash, digest) takes part.

Texts are equal if they are after lower-casing A-Z; null counts as empty, and empty texts are copies of each
other.  Of equal texts the largest doc_id stays (all rows with it, if a row is repeated).  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, numbered, table

#: Distinct keys of a bucket; the directory, of two entries a bucket or so, is what the driver holds.
CAPACITY = 1024
MOST_BUCKETS = 1 << 15
#: Bytes of texts that a task keeps in order to collapse copies.
WINDOW = 16 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def key_of(norm: bytes) -> int:
    return xxhash.xxh3_64_intdigest(norm) - (1 << 63)


class Directory:
    """Extendible hashing's directory over the leading bits of keys (moved to be unsigned)."""

    def __init__(self) -> None:
        self.depth, self.slots = 0, np.zeros(1, np.int32)
        self.local, self.first = [0], [0]  # of each bucket its depth, and its least key

    def double(self) -> None:
        self.slots = np.repeat(self.slots, 2)
        self.depth += 1

    def split(self, bucket: int) -> tuple[int, int]:
        """The lower half of the bucket's keys keeps its number, the upper half gets a new one."""
        if self.local[bucket] == self.depth:
            self.double()
        self.local[bucket] += 1
        new, half = len(self.local), self.first[bucket] + (1 << (64 - self.local[bucket]))
        self.local.append(self.local[bucket])
        self.first.append(half)
        at = half >> (64 - self.depth)
        self.slots[at : at + (1 << (self.depth - self.local[bucket]))] = new
        return bucket, new

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        unsigned = keys.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        at = unsigned >> np.uint64(64 - self.depth) if self.depth else np.zeros(len(keys), np.uint64)
        return self.slots[at.astype(np.int64)]


def split_over(counts: np.ndarray, capacity: int) -> tuple[Directory, bool]:
    """A directory whose buckets hold at most `capacity` of the keys that `counts` has by their leading bits, and whether these bits were enough."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    out, todo, enough = Directory(), [(0, 0, len(counts))], True
    while todo:
        bucket, lo, hi = todo.pop()
        if upto[hi] - upto[lo] <= capacity:
            continue
        if hi - lo == 1:
            enough = False
            continue
        low, new = out.split(bucket)
        todo += [(low, lo, (lo + hi) // 2), (new, (lo + hi) // 2, hi)]
    return out, enough


def directory(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """Split buckets until none is overfull. keys: distinct `key`.

    Counts by leading bits reach the driver, 8 to 16 for each bucket; beyond 2^25 keys buckets grow instead, so it never holds more than MOST_BUCKETS or so.
    """
    n = keys.count()
    capacity = max(capacity, -(-n // MOST_BUCKETS))
    bits = max(1, int(n / capacity).bit_length() + 3)
    while True:
        lead = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)
        found = keys.groupBy(lead.alias("lead")).count().toPandas()
        counts = np.zeros(1 << bits, np.int64)
        counts[found["lead"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
        out, enough = split_over(counts, capacity)
        if enough or bits >= 24:  # more keys than a bucket's in one of 2^24 ranges: it stays overfull, and its owner chains them all the same
            return out
        bits += 4


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norms = [normalise(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([key_of(n) for n in norms], pa.int64()), pa.array([hashlib.sha256(n).digest() for n in norms], pa.binary())], ["doc_id", "key", "digest"])


OWNED = "bucket int, key long, norm binary, keep_id long, n long"
INDEX = "bucket int, key long, chain int, digest binary, keep_id long, group_size long"


def _later(a: int | None, b: int | None) -> int | None:
    return a if b is None else b if a is None else max(a, b)


def _collapse(slots: Directory):
    """Copies within a window of texts become one row with their count and largest id."""

    def out(seen: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        items = list(seen.items())
        for at in range(0, len(items), 256):
            part = items[at : at + 256]
            keys = np.array([key_of(n) for n, _ in part], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots.lookup(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array([n for n, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], ["bucket", "key", "norm", "keep_id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                norm = normalise(text.as_py())
                if (entry := seen.get(norm)) is None:
                    seen[norm] = [doc_id, 1]
                    held += len(norm) + 200
                    if held > WINDOW:
                        yield from out(seen)
                        seen, held = {}, 0
                else:
                    entry[0], entry[1] = _later(entry[0], doc_id), entry[1] + 1
        yield from out(seen)

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the chain of one key is all that is held besides the entries to write."""
    done: list[tuple] = []
    chain: list[list] = []
    now = None

    def close() -> None:
        for k, (norm, keep_id, n) in enumerate(chain):
            done.append((now[0], now[1], k, hashlib.sha256(norm).digest(), keep_id, n))

    def write() -> pa.RecordBatch:
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 6, types, strict=True)], names)

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "key", "norm", "keep_id", "n")]
        for bucket, key, norm, keep_id, n in zip(*cols, strict=True):
            if now != (bucket, key):
                close()
                chain, now = [], (bucket, key)
            for entry in chain:
                if entry[0] == norm:
                    entry[1], entry[2] = _later(entry[1], keep_id), entry[2] + n
                    break
            else:
                chain.append([norm, keep_id, n])
        if len(done) > 10_000:
            yield write()
            done.clear()
    close()
    yield write()


def build_index(docs: DataFrame, keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index's entries, written by their owners. docs: doc_id, text; keys: of _keys, written."""
    slots = directory(materialise(keys.select("key").distinct()), capacity)
    texts = docs.mapInArrow(_collapse(slots), OWNED)
    return materialise(texts.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(_own, INDEX))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = materialise(docs.mapInArrow(_keys, "doc_id long, key long, digest binary"))
    index = build_index(docs, keys, capacity)
    found = keys.join(index.select("key", "digest", "keep_id", "group_size"), ["key", "digest"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of equal texts one row, with the largest doc_id; the columns of docs."""
    rows, row, _ = numbered(docs, nulls_first=True)
    dropped = groups(rows, row).where(~F.col("kept")).select(F.col("doc_id").alias(row))
    return rows.join(dropped, row, "left_anti").select([f"`{c}`" for c in docs.columns])


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""
