"""Licence scan: the digest of a normalised text, looked up among the digests of known licences.

Normalising lower-cases, takes out copyright lines, makes every run of other
characters than letters and digits one space and replaces equivalent spellings.
Whole texts are joined with the known digests; each line that speaks of a licence is a
text of its own and is looked up as well.  Null counts as empty; an empty text has
the digest of the empty string and no licence.  Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import hashlib

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _licence_texts as known
from ._common import table

COPYRIGHT = r"(?:^|\n)[ \t]*(?:copyright|\(c\)|©)[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"
#: A line can only equal a known notice if this finds something in it (checked for the table of notices).
SPEAKS = r"(?i)licen[cs]e|public domain|copyright|spdx"


def normalise_text(text: str | None) -> str:
    text = regex.sub(OTHER, " ", regex.sub(COPYRIGHT, "", (text or "").lower()))
    text = f" {text.strip(' ')} "
    for a, b in known.SPELLINGS:
        text = text.replace(f" {a} ", f" {b} ")
    return text.strip(" ")


def normalise(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, ""), OTHER, " ")
    text = F.concat(F.lit(" "), F.trim(text), F.lit(" "))
    for a, b in known.SPELLINGS:
        text = F.replace(text, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(text)


def digest(text: str) -> str:
    return hashlib.sha256(normalise_text(text).encode()).hexdigest()


@functools.cache
def known_texts() -> dict[str, str]:
    """Digest to licence of whole texts: each complete licence, and each short text as it is and below its titles."""
    out = {digest(text): name for name, text in known.whole_texts()}
    for name, title, text in known.TEXTS:
        for body in {normalise_text(t): t for t in known.layouts(text)}.values():
            for head in ("", *(f"{t}\n" for t in [title, *known.TITLES[name]])):
                out |= {digest(f"{head}{body}"): name, digest(f"{head}{known.RESERVED}\n{body}"): name}
    return out | known_notices()


def known_notices() -> dict[str, str]:
    out = {}
    for name, lines in known.NOTICES.items():
        for line in lines:
            assert regex.search(SPEAKS, line), line
            out[digest(line)] = name
    return out


def scan(docs: DataFrame, texts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_digest, licence (of the whole text, or null), n_notices and notices (licences named by lines, sorted, comma-joined).

    texts(digest, licence) may replace the built-in table of whole texts; Spark broadcasts it only
    if it is below the session's threshold and shuffles on the digest otherwise.
    """
    spark = docs.sparkSession
    if texts is None:
        texts = spark.createDataFrame(sorted(known_texts().items()), "digest string, licence string")
    texts = texts.select(F.col("digest").alias("text_digest"), F.col("licence").alias("licence")).dropDuplicates(["text_digest"])
    notices = F.create_map(*[F.lit(x) for kv in sorted(known_notices().items()) for x in kv])
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(SPEAKS))
    found = F.filter(F.transform(lines, lambda x: F.element_at(notices, F.sha2(normalise(x), 256))), lambda x: x.isNotNull())
    named = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalise(F.col(text_col)), 256).alias("text_digest"), F.when(F.col(text_col).rlike(SPEAKS), found).otherwise(F.array().cast("array<string>")).alias("found"))
    return named.join(texts, "text_digest", "left").select("doc_id", "text_digest", "licence", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_normalised(x: str) -> str:
    out = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{COPYRIGHT}', '', 'g'), '{OTHER}', ' ', 'g')"
    out = f"' ' || trim({out}, ' ') || ' '"
    for a, b in known.SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out}, ' ')"


def oracle() -> str:
    pairs = lambda d: ", ".join(f"('{k}', '{v}')" for k, v in sorted(d.items()))
    return f"""
    WITH texts(text_digest, licence) AS (VALUES {pairs(known_texts())}),
    notices(digest, name) AS (VALUES {pairs(known_notices())}),
    d AS (SELECT row_number() OVER () AS row_no, doc_id, text, sha256({_sql_normalised('text')}) AS text_digest FROM documents),
    lines AS (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM d),
    named AS (SELECT row_no, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
              FROM lines JOIN notices ON notices.digest = sha256({_sql_normalised('line')})
              WHERE regexp_matches(line, '{SPEAKS}') GROUP BY row_no)
    SELECT doc_id, text_digest, licence, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices
    FROM d LEFT JOIN texts USING (text_digest) LEFT JOIN named USING (row_no)
    """
