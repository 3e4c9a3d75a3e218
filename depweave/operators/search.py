"""Lexical, vector and fused search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .graph import ranked

K1, B, RRF_K = 1.2, 0.75, 60


def spaced(text: Column) -> Column:
    """The words of a text, runs of a-z and 0-9 in lower case, with two spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "  "))


def n_words(words: Column) -> Column:
    return F.when(words == "", 0).otherwise(F.expr("1") + ((F.length(words) - F.length(F.replace(words, F.lit("  "), F.lit("")))) / 2).cast("int"))


def terms_of(query: str) -> list[str]:
    return sorted(set("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()))


def postings(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """(id, keep, dl, term, tf), and for every text a row of the term '' and tf 0, which holds its length."""
    words = docs.select(F.col(id_col).alias("id"), *(keep or []), spaced(F.col(text_col)).alias("w")).withColumn("dl", n_words(F.col("w")))
    each = F.concat(F.array(F.lit("")), F.when(F.col("w") == "", F.array().cast("array<string>")).otherwise(F.split("w", "  ")))
    out = words.select("id", *(keep or []), "dl", F.explode(each).alias("term")).groupBy("id", *(keep or []), "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    return out.withColumn("tf", F.when(F.col("term") == "", 0).otherwise(F.col("tf")))


def _weight(n: int, df: int, avg: float, tf: Column) -> Column:
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avg)))


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of the texts that hold a term of the query.

    One pass over the texts writes a text's length and its counts of the query's terms; statistics and scores are read off that table.
    """
    terms = terms_of(query)
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    words = docs.select(F.col(id_col).alias("id"), spaced(F.col(text_col)).alias("w"))
    # Every word has a space of its own on both sides, so what goes when a term is taken out counts it.
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    times = lambda t: ((F.length(padded) - F.length(F.replace(padded, F.lit(f" {t} "), F.lit("")))) / (len(t) + 2)).cast("int")
    counts = written(words.select("id", n_words(F.col("w")).alias("dl"), *[times(t).alias(f"tf{k}") for k, t in enumerate(terms)]))
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]).first()
    score = F.lit(0.0)
    for k in range(len(terms)):
        score = score + _weight(stats["n"], stats[f"df{k}"], stats["avg"] or 1.0, F.col(f"tf{k}"))
    hit = F.greatest(*[F.col(f"tf{k}") for k in range(len(terms))], F.lit(0)) > 0
    return counts.where(hit).select("id", score.alias("score"))


def bm25_of(index: DataFrame, query: str) -> DataFrame:
    """(id, score) as bm25, from stored postings (id, dl, term, tf): only those of the query's terms and the lengths are read."""
    terms = terms_of(query)
    stats = index.where("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
    hits = index.where(F.col("term").isin(terms)) if terms else index.limit(0)
    found = {r["term"]: r["count"] for r in hits.groupBy("term").count().collect()}
    score = F.lit(0.0)
    for t in sorted(found):
        score = score + F.when(F.col("term") == t, _weight(stats["n"], found[t], stats["avg"] or 1.0, F.col("tf"))).otherwise(0.0)
    return hits.groupBy("id").agg(F.sum(score).alias("score"))


def cosine(vectors: DataFrame, query: list[float], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score); no rows for a query of norm zero."""
    norm = math.sqrt(sum(x * x for x in query))
    if norm == 0:
        return vectors.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vec_col, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select(F.col(id_col).alias("id"), (dot / (own * norm + 1e-10)).alias("score"))


def top(scores: DataFrame, n: int) -> DataFrame:
    return ranked(scores, n, F.desc("score"), F.asc("id"))


def overfetch(limit: int) -> int:
    """Candidates of each list before they are fused."""
    return max(3 * limit, 50)


def fused(first: DataFrame, second: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists (id, rank): sum of 1 / (k + rank)."""
    both = first.select("id", "rank").union(second.select("id", "rank"))
    return both.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, rank) of the fused lists; lexical only where the vector is empty or zero."""
    n = overfetch(limit)
    return top(fused(top(bm25(docs, query, id_col, text_col), n), top(cosine(vectors, vector), n)), limit)
