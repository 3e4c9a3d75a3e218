"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each component is a list of the candidates sorted by it.  A query reads its lists from the end where its
own component's sign puts the largest contributions, all lists to the same depth.  What a candidate has shown gives a lower bound
(unread components at their list's minimum) and an upper bound (at the depth's value); reading stops for a query when
every candidate outside its k best lower bounds has a smaller upper bound or few enough remain,
and the remaining ones' final scores are resolved.  Bounds of a block of queries over a block of candidates are two matrix products.

Queries are taken in blocks against all rows in blocks; every pair of blocks is one row of a shuffle, its result the
best k of that block, and the best k of these are the answer.  Scores are integers and exact; where products of a block may pass 62 bits, Python's
integers rank it without bounds, and scores beyond 64 bits are given as the nearest such number.

Vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded with zeros.  Rows
with the query's vec_id are not its candidates; of repeated vec_ids each row is a candidate, and the first of its vectors in order is the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialise, table

K, EVERY, SCALE = 20, 20, 64
#: Most rows of a block of candidates and of queries; least number of blocks of candidates, for as many tasks.
CANDIDATES, QUERIES, LEAST_BLOCKS = 8192, 2048, 24
#: Depths, as shares of the lists, at which bounds are compared; a query that none of them settles reads its lists to their ends.
DEPTHS = (0.25, 0.6, 0.8, 0.9, 0.95, 0.98)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of the vectors that take part."""
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & fine).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _pack(rows: DataFrame, block: str) -> DataFrame:
    """One row per block: ids and the flattened matrix."""
    width = F.max(F.size("v")).alias("width")
    return rows.groupBy(block).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"), width)


def _matrix(rows: pa.StructArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = rows.field("vec_id").to_numpy(), rows.field("v")
    sizes = pc.list_value_length(vectors).to_numpy()
    out = np.zeros((len(rows), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def _exact_type(q: np.ndarray, x: np.ndarray) -> type:
    """The fastest type that holds every partial sum exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] * 2
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def unsettled(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray | None]:
    """For each query the candidates (rows of x) left when its reading stops, or None if its lists are read to their ends. ids ascend."""
    kind = _exact_type(q, x)
    n = len(ids)
    remaining: list[np.ndarray | None] = [None] * len(q)
    if n <= 2 * k or kind is object:
        return remaining
    weights = np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], axis=1).astype(kind)
    lists = np.concatenate([x, -x], axis=1).astype(kind)
    ordered = -np.sort(-lists, axis=0)  # each list from its largest value
    active = np.arange(len(q))
    for depth in DEPTHS:
        if not len(active):
            break
        frontier = ordered[min(n - 1, int(depth * n))]
        shown = lists >= frontier
        low = weights[active] @ np.where(shown, lists, ordered[-1]).T
        high = weights[active] @ np.maximum(lists, frontier).T
        own = ids[None, :] == q_ids[active][:, None]
        low[own] = np.iinfo(np.int64).min // 2 if kind is np.int64 else -np.inf
        kth = np.partition(low, n - k, axis=1)[:, n - k]
        alive = (high >= kth[:, None]) & ~own
        few = alive.sum(axis=1) <= max(2 * k, n // 16)
        for row in np.flatnonzero(few):
            remaining[active[row]] = np.flatnonzero(alive[row])
        active = active[~few]
    return remaining


def nra(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: its id, and ids and scores of the best k candidates of the block, ties to smaller ids. ids ascend."""
    kind = _exact_type(q, x)
    exact = x.astype(kind)
    remaining = unsettled(q_ids, q, ids, x, k)
    # Read to their ends, lists show every candidate whole: bounds and scores are the same.
    whole = np.array([i for i, r in enumerate(remaining) if r is None], int)
    scores = q[whole].astype(kind) @ exact.T if len(whole) else None
    at = {int(i): row for row, i in enumerate(whole)}
    for i, left in enumerate(remaining):
        if left is None:
            left = np.flatnonzero(ids != q_ids[i])
            score = scores[at[i]][left]
        else:
            score = exact[left] @ q[i].astype(kind)
        if len(left) > k:
            bound = np.partition(score, len(left) - k)[len(left) - k]
            above = np.flatnonzero(score > bound)
            ties = np.flatnonzero(score == bound)[: k - len(above)]
            pick = np.concatenate([above, ties])
            left, score = left[pick], score[pick]
        most = np.iinfo(np.int64)
        yield q_ids[i], ids[left], np.clip(score, most.min, most.max).astype(np.int64) if kind is object else score.astype(np.int64)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width = max(batch.column(c)[i].as_py() for c in ("q_width", "width"))
                (q_ids, q), (ids, x) = (_matrix(batch.column(c)[i].values, width) for c in ("queries", "rows"))
                for lo in range(0, len(q_ids), 512):
                    found = list(nra(q_ids[lo : lo + 512], q[lo : lo + 512], ids, x, k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if len(c) else [], pa.int64()) for c in ([np.full(len(f[1]), f[0]) for f in found], [f[1] for f in found], [f[2] for f in found])], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = materialise(quantised(vectors, scale))
    n = rows.count()
    blocks = max(LEAST_BLOCKS, -(-n // CANDIDATES))
    first = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    q_blocks = max(1, -(-n // every // QUERIES))
    spread = lambda of, m: F.pmod(F.xxhash64("vec_id", F.lit(of)), F.lit(m)).cast("int")
    queries = _pack(first.withColumn("q_block", spread(1, q_blocks)), "q_block").select("q_block", F.col("rows").alias("queries"), F.col("width").alias("q_width"))
    packed = materialise(_pack(rows.withColumn("block", spread(2, blocks)), "block"))
    # Blocks meet by a shuffle on both numbers, so that no task gets more than its pairs.
    sides = [queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), packed.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))]
    best = sides[0].hint("shuffle_hash").join(sides[1], ["q_block", "block"]).select("queries", "rows", "q_width", "width").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {K}
"""
