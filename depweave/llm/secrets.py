"""Secret scan: three base patterns, and spans that a pair of character Markov models finds.

One model holds the transitions of random strings, the other those of ordinary
identifiers; a token whose mean log-likelihood ratio is above a threshold, which no base span overlaps, is a
further span; it has LEAST characters at least and a letter, since numbers alone are no secrets.  Both are counted by Spark from labelled samples into a table of the alphabet's size squared.
Only SQL functions run over the texts; no row is shuffled.

Null and empty texts have no span.  Repeated rows give repeated results.  Positions are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Kinds in the order of ties, pattern, group of which the length counts, least length.
BASE = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    # Of these two only matches of the least length are searched for: shorter runs hold none, so the kept ones are the same.
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Fewest characters of a token that the models judge: of fewer, too many ordinary names look random.
LEAST = 16
TOKEN = rf"(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Mean log-likelihood ratio of a transition from which on a token counts as random.
LEAST_RATIO = 0.5

#: Parts of ordinary identifiers, paths and compound words.
PARTS = """
get set add new old max min num is has to from by of in on with for and or not all any index count size length name value key user id file path dir
config option default list map array table row column data type kind class object string number integer float double char byte buffer stream reader writer
read write open close load save parse format print log error warning debug info message request response server client host port address network socket
session context manager handler factory builder service module package import export test check verify update delete create insert select query result
time date day month year start end begin first last next previous current total average sum offset limit width height color image font text line word
http https www com org net html index static assets images download upload account profile settings password reset token login logout register verification
super cali fragi listic over under inter national trans formation under standing counter revolution communication responsibility characterization
geschwindigkeit verordnung gesellschaft wirtschaft versicherung entwicklung freundschaft anticonstitutionnellement naturellement gouvernement developpement
desarrollo responsabilidad comunicacion universidad electroencefalografista the tion ing and ent ere her that thin ered ation ever other ness ment able
""".split()


def labelled_samples(spark: SparkSession, each: int = 3000) -> DataFrame:
    """sample, random: strings of digests in several alphabets; identifiers of ordinary parts, and rules of one sign or of tables."""
    digest = F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")), 512)
    packed = F.base64(F.unhex(digest))
    random = spark.range(each).select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.substring(digest, 3, 32))).when(F.col("id") % 4 == 2, F.regexp_replace(packed, "[+/=]", "")).otherwise(packed).alias("sample"), F.lit(True).alias("random")
    )
    part = lambda k: F.element_at(F.array(*map(F.lit, PARTS)), (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    parts = [part(k) for k in range(5)]
    camel = F.concat(parts[0], *map(F.initcap, parts[1:]))
    numbered = F.concat_ws("_", *parts[:4], (F.col("id") % 100).cast("string"))
    ordinary = spark.range(each).select(
        F.when(F.col("id") % 10 == 9, F.repeat(F.substring(F.lit("-=_+/-"), (F.col("id") / 10 % 6).cast("int") + 1, 1), 24)).when(F.col("id") % 10 == 8, F.concat(F.lit("+"), F.repeat(F.lit("-"), (F.col("id") / 10 % 7).cast("int") + 3), F.lit("+"), F.repeat(F.lit("="), 8), F.lit("+")))
        .when(F.col("id") % 6 == 0, F.concat_ws("_", *parts)).when(F.col("id") % 6 == 1, camel).when(F.col("id") % 6 == 2, F.concat_ws("/", *parts)).when(F.col("id") % 6 == 3, F.concat_ws("-", *parts)).when(F.col("id") % 6 == 4, F.concat(*parts)).otherwise(F.upper(numbered)).alias("sample"),
        F.lit(False).alias("random"),
    )
    return random.unionByName(ordinary)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, random over ordinary, with add-one smoothing. At most twice the table's size reaches the driver."""
    n = len(ALPHABET)
    chars = samples.select("random", F.filter(F.split("sample", ""), lambda c: (c != "") & F.lit(ALPHABET).contains(c)).alias("c")).where(F.size("c") > 1)
    pairs = chars.select("random", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))).alias("p"))
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("random", "p.a", "p.b").agg(F.count("*").alias("n")).collect()}
    ratios = []
    for a in ALPHABET:
        totals = {k: sum(counts.get((k, a, b), 0) for b in ALPHABET) + n for k in (True, False)}
        ratios += [math.log((counts.get((True, a, b), 0) + 1) / totals[True]) - math.log((counts.get((False, a, b), 0) + 1) / totals[False]) for b in ALPHABET]
    return ratios


def _found(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches: the gap before each match is captured too, so lengths add up to positions."""
    whole = f"(?s)(.*?)({pattern}|\\z)"
    parts = [F.regexp_extract_all(text, F.lit(whole), F.lit(k)) for k in (1, 2, 2 + group)]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(F.char_length(x["part"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(parts[0].alias("gap"), parts[1].alias("hit"), parts[2].alias("part"))
    return F.when(text.rlike(pattern), F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def scan(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and an array of spans (start, kind, end, hit): base kinds by their order, then 3 for the models'."""
    n = len(ALPHABET)
    ratio = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    text = F.col("_text")
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = out.select("doc_id", *[_found(text, p, group, least, k).alias(name) for k, (name, p, group, least) in enumerate(BASE)], _found(text, TOKEN, 0, LEAST, len(BASE)).alias("tokens"))
    out = out.select("doc_id", F.concat(*[name for name, *_ in BASE]).alias("base"), "tokens")

    def mean_ratio(token: Column) -> Column:
        at = lambda c: F.instr(F.lit(ALPHABET), c)
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("p"))
        added = lambda acc, c: F.struct((acc["s"] + F.when(acc["p"] == 0, 0.0).otherwise(F.element_at(ratio, (acc["p"] - 1) * n + F.greatest(at(c), F.lit(1))))).alias("s"), F.greatest(at(c), F.lit(1)).alias("p"))
        return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), start, added, lambda acc: acc["s"]) / (F.char_length(token) - 1)

    apart = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    random = F.filter("tokens", lambda t: apart(t) & (mean_ratio(t["hit"]) >= LEAST_RATIO))
    return out.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", random)).alias("spans"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), train(labelled_samples(spark)))
    kinds = F.array(*[F.lit(name) for name, *_ in BASE], F.lit("markov"))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
