"""Training-data operators. Nothing else in the package imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> (module, name of its DuckDB SQL or None where SQL can't express it).
QUERIES = {
    "op1_quality_resampling": ("quality_classifier", None),
    "op2_chat_format": ("chat_format", "OP2_SQL"),
    "op3_line_dedup": ("line_dedup", "OP3_SQL"),
    "op4_quality_rules": ("quality_rules", "OP4_SQL"),
    "op5_decontaminate": ("decontaminate", "OP5_SQL"),
    "op6_warc": ("warc", "OP6_SQL"),
    "op7_lm_scoring": ("lm_scoring", None),
    "op8_mixing": ("mixing", None),
    "op9_simhash_bk": ("simhash_bk", None),
    "op10_html_extract": ("html_extract", None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, (module, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__name__}.{module}"), sql) for name, (module, sql) in QUERIES.items() if sql}
