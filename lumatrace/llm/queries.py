"""Queries of the corpus operators and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, curves, decontaminate, extract, language, ranked, resample, simhash, substrings, toolcalls, topk, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_urls": urls.op3_urls,
        "op4_substrings": substrings.op4_substrings,
        "op5_bpe": bpe.op5_bpe,
        "op6_language": language.op6_language,
        "op7_extract": extract.op7_extract,
        "op8_simhash": simhash.op8_simhash,
        "op9_toolcalls": toolcalls.op9_toolcalls,
        "op10_topk": topk.op10_topk,
        "op11_curves": curves.op11_curves,
        "op12_ranked": ranked.op12_ranked,
        "op13_resample": resample.op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op3_urls": urls.OP3_SQL,
        "op9_toolcalls": toolcalls.OP9_SQL,
        "op10_topk": topk.OP10_SQL,
        "op12_ranked": ranked.OP12_SQL,
        "op13_resample": resample.OP13_SQL,
    }
