"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import ship

#: query name: module of this subpackage, with query(spark, sf_dir) and, where SQL can express it, SQL.
MODULES = {
    "op1_mix_sources": "mixing",
    "op2_document_fingerprints": "minhash",
    "op3_language_id": "language",
    "op4_html_extraction": "html_text",
    "op5_bpe": "bpe",
    "op6_quality_classifier": "quality",
    "op7_exact_dedup": "exact_dedup",
    "op8_toxicity": "toxicity",
    "op9_chat_formatting": "chat",
    "op10_simhash_near_dedup": "simhash",
    "op11_nearest_neighbours": "one_bit",
    "op12_conversation_repair": "repair",
    "op13_fill_in_middle": "infill",
    "chat_tool_calls": "chat_calls",
}


def _runner(module: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return import_module(f"ledgerline.llm.{module}").query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"ledgerline.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
