"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op5_url_filters": "url_filters",
    "op1_masked_lm": "masked_lm",
    "op2_token_counts": "token_counts",
    "op3_quality_classifier": "quality_classifier",
    "op4_jaccard_join": "jaccard_join",
    "op6_token_files": "token_files",
    "op7_packing": "packing",
    "op8_decontamination": "decontamination",
    "op9_quality_rules": "quality_rules",
    "op10_pii": "pii",
    "op11_periodic_runs": "periodic_runs",
    "op12_html_extraction": "html_extraction",
    "op13_spelling_variants": "spelling_variants",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q: getattr(import_module(f"linkscore.llm.{m}"), q) for q, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for query, module in _MODULES.items():
        sql = getattr(import_module(f"linkscore.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[query] = sql
    return found
