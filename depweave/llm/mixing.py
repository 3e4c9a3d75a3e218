"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight; sorted by it within
its source, sizes are summed until the source's budget.  A target above the source's size first takes whole epochs
of every document, the rest is the fractional selection; the document on which the budget ends is taken
if at least half of it fits.  Keys come from a digest of the seed and the doc_id, so reruns agree.

No source is ever gathered in one task: keys are cut into buckets by their logarithm, of a width of 1 / sqrt(n), so that
one holds 0.37 sqrt(n) rows or so at most whatever the weights are (an exponential variable's logarithm has no greater density), bucket totals are summed up, and only the one bucket of each source in which the budget ends is sorted by rows.
The outcome is a cut (key, doc_id) per source, which is all that is joined to documents.

Null and wordless texts have size 0 and are never taken; null is a source of its own, last in order.  Rows with
equal key and doc_id (repeated rows) are taken together.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialise, table

#: Weights of sources in order, repeating; times its size that a source may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of runs of other characters than white space."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(runs, r"[\x20\x09-\x0D]+", "")).cast("long")


def quality(text: Column) -> Column:
    """Between 0.1 and 1.1: a tenth more than the share of letters, of any script, among the characters."""
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", ""))
    return F.lit(0.1) + letters / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))


def exponential(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, u from 52 bits of md5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(16**13)) / weight


def keyed(docs: DataFrame, weight: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, key."""
    weight = quality(F.col(text_col)) if weight is None else weight
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), exponential(F.col(id_col), weight).alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n, source_size, target from one row per source (source, n, source_size).

    A source is capped if its cap is at most its share of what the sources with smaller cap per
    weight leave; the rest shares by weight.  Windows over one row per source.
    """
    order = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("rank", F.row_number().over(by_cap)).withColumn("level", left / weight_left)
    ranked = ranked.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct("rank", "level"))).over(all_rows)["level"]
    return ranked.select("source", "n", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, epochs, cut_key, cut_id: a document is taken epochs times, and once more up to the cut.

    rows: keyed() as a written table, since it is read three times.
    """
    stats = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    plan = targets(stats, weights, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = materialise(plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.sqrt("n"))))
    own = F.col("d.source").eqNullSafe(F.col("p.source"))
    spread = rows.alias("d").join(plan.alias("p"), own).select("d.*", "p.budget", F.floor(F.col("p.buckets") * F.ln("d.key")).alias("bucket"))
    totals = materialise(spread.groupBy("source", "bucket").agg(F.sum("size").alias("total"), F.max("budget").alias("budget")))
    up_to = F.sum("total").over(W.partitionBy("source").orderBy("bucket"))
    # The last bucket that begins below the budget: all before it is taken whole.
    ends = totals.withColumn("above", up_to - F.col("total")).where(F.col("above") < F.col("budget"))
    ends = ends.groupBy("source").agg(F.max(F.struct("bucket", "above")).alias("e")).select("source", "e.bucket", "e.above")
    near = spread.alias("s").join(ends.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.bucket") == F.col("e.bucket"))).select("s.*", "e.above")
    sums = F.sum("size").over(W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    near = near.withColumn("fits", F.col("above") + sums - F.col("size") / 2 <= F.col("budget"))
    # Buckets before the last one are below its first key: where nothing of it fits, the cut is just below that key.
    last = near.groupBy("source").agg(F.max(F.when(F.col("fits"), F.struct("key", "doc_id"))).alias("cut"), F.min(F.struct("key", "doc_id")).alias("first"))
    at = last.select("source", F.coalesce("cut", "first")["key"].alias("cut_key"), F.col("cut")["doc_id"].alias("cut_id"), F.col("cut").isNotNull().alias("with_cut"))
    return materialise(plan.alias("p").join(at.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.source", "p.source_size", "p.target", "p.epochs", "c.cut_key", "c.cut_id", "c.with_cut"))


def _inside() -> Column:
    """Whether a row d comes before the cut c, or is it; null ids come first, as in the windows."""
    upto = F.coalesce(F.col("d.doc_id") <= F.col("c.cut_id"), F.col("d.doc_id").isNull())
    return F.coalesce((F.col("d._key") < F.col("c.cut_key")) | ((F.col("d._key") == F.col("c.cut_key")) & F.col("c.with_cut") & upto), F.lit(False))


def taken_times(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """rows (with source, key, doc_id) and what the mix does: source_size, target and times, how often each row is taken."""
    joined = rows.withColumnRenamed("key", "_key").alias("d").join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    return joined.select("d.*", "c.source_size", "c.target", (F.col("c.epochs") + _inside().cast("long")).alias("times"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(keyed(table(spark, sf_dir, "documents")))
    return taken_times(rows, cuts(rows)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves, repeated as often as they are taken; the columns of docs."""
    rows = materialise(keyed(docs))
    cut = cuts(rows)
    own = docs.withColumn("_key", exponential(F.col("doc_id"), quality(F.col("text"))))
    times = (F.col("c.epochs") + _inside().cast("long")).cast("int")
    joined = own.alias("d").join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    joined = joined.where(F.col("d.text").rlike(r"[^\x20\x09-\x0D]"))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def oracle() -> str:
    from functools import reduce

    weight = reduce(lambda rest, kw: f"WHEN {kw[0]} THEN {kw[1]} {rest}", reversed(list(enumerate(WEIGHTS))), "")
    return rf"""
    WITH d AS (SELECT doc_id, source,
          CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size,
          -ln((CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / {float(16**13)}::DOUBLE)
          / (0.1::DOUBLE + length(regexp_replace(coalesce(text, ''), '[^\p{{L}}]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)) AS key
        FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weight} END AS weight, source_size * {MOST} AS cap FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rank FROM w),
    l AS (SELECT *, (CAST((SELECT sum(source_size) FROM r) AS BIGINT) - CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT))
                    / (CAST((SELECT sum(weight) FROM r) AS BIGINT) - CAST(coalesce(sum(weight) OVER b, 0) AS BIGINT)) AS level
          FROM r WINDOW b AS (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE)
              ELSE (SELECT level FROM l AS x WHERE NOT x.cap <= x.level * x.weight ORDER BY rank LIMIT 1) * weight END AS target FROM l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
    p AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
            sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
          FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, round(target, 6) AS target,
           CAST(size * (epochs + CASE WHEN upto - size / 2 <= budget AND upto - size < budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
    """
