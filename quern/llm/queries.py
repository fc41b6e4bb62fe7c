"""The queries of this subpackage: opN_<name> applies operator N, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quern.llm import oracles

#: query -> module that has it.
PLACES = {
    "op1_substring_dedup": "substrings",
    "op2_quality_rules": "quality",
    "op3_license_scan": "licenses",
    "op4_chat_formatting": "chat",
    "op5_line_dedup": "lines",
    "op6_near_duplicates": "neardup",
    "op7_toxicity": "toxicity",
    "op8_decontamination": "decontamination",
    "op9_token_output": "tokens",
    "op10_mixing": "mixing",
    "op11_quality_classifier": "attention",
    "op12_lexical_search": "retrieval",
    "op13_vector_codes": "codes",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"quern.llm.{module}"), name) for name, module in PLACES.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
