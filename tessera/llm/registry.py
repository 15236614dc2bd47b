"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_ngram_join, op2_substrings, op3_bytes, op10_embeddings, op11_licenses, op12_whitening, op13_filters, op4_secrets, op5_mix, op6_decontaminate, op7_urls, op8_language, op9_lm

_MODULES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_substring_dedup": op2_substrings,
    "op3_suffix_dedup": op3_bytes,
    "op4_secrets": op4_secrets,
    "op5_mix": op5_mix,
    "op6_decontaminate": op6_decontaminate,
    "op7_url_filter": op7_urls,
    "op8_language_id": op8_language,
    "op9_lm_score": op9_lm,
    "op10_embedding_near_dup": op10_embeddings,
    "op11_license_scan": op11_licenses,
    "op12_whitening": op12_whitening,
    "op13_filter_audit": op13_filters,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()} | {"pages_language": op8_language.pages_query}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _MODULES.items() if getattr(module, "ORACLE", None)}
