"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query: its module and function, and the name of its SQL there.
_QUERIES = {
    "op1_decontamination": ("decontam", "op1", "SQL1"),
    "op2_html_extraction": ("html_extract", "op2", None),
    "op3_quality_rules": ("quality_rules", "op3", "SQL3"),
    "op4_quality_classifier": ("quality_classifier", "op4", None),
    "op5_license_scan": ("license_scan", "op5", "SQL5"),
    "op6_token_store": ("token_store", "op6", None),
    "op7_line_dedup": ("line_dedup", "op7", "SQL7"),
    "op8_simhash": ("simhash", "op8", None),
    "op9_sentencepiece": ("pieces", "op9", None),
    "op10_pii": ("pii", "op10", "SQL10"),
}


def _run(module: str, f: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return getattr(import_module(f"lexmill.llm.{module}"), f)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, module, f) for name, (module, f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"lexmill.llm.{module}"), sql) for name, (module, _, sql) in _QUERIES.items() if sql}
