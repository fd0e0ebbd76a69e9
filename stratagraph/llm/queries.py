"""Queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: name -> module that holds the function of that name
OPERATORS: dict[str, str] = {
    "op1_ngram_join": "ngram_join",
    "op2_quality_rules": "quality_rules",
    "op3_quality_classifier": "quality_classifier",
    "op4_nearest": "ann",
    "op5_url_filter": "url_filter",
    "op6_pii": "pii",
    "op7_token_records": "records",
    "op8_language_id": "langid",
    "op9_byte_bpe": "bpe",
    "op10_packing": "packing",
    "op11_lexical": "lexical",
    "op12_simhash": "simhash",
    "op13_centroids": "centroids",
    # The same operator with redirects beside the pages, which hold none.
    "url_alias_verdicts": "url_filter",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {}) for name, module in OPERATORS.items()}
    return {name: sql[name] for name, sql in found.items() if name in sql}
