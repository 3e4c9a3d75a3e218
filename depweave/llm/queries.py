"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, language, licences, mixing, near_dedup, quality, secrets, top_k, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    functions = [licences.op1_licence_scan, secrets.op2_secret_scan, mixing.op3_mix_sources, exact_dedup.op4_exact_dedup, top_k.op5_top_k, near_dedup.op6_near_dedup, toxicity.op7_toxicity, quality.op8_quality, language.op9_language, bpe.op10_bpe]
    return {f.__name__: f for f in functions}


def oracle_sql() -> dict[str, str]:
    return {"op1_licence_scan": licences.oracle(), "op3_mix_sources": mixing.oracle(), "op4_exact_dedup": exact_dedup.ORACLE, "op5_top_k": top_k.ORACLE}
