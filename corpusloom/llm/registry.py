"""Queries of the operators by name, with SQL where SQL can express them."""

from __future__ import annotations

import importlib

_QUERIES = {
    "op12_phrase_collocations": "collocations",
    "op13_hard_negatives": "hard_negatives",
    "op11_byte_bpe": "byte_bpe",
    "op5_decontamination": "decontamination",
    "op6_jaccard_join": "jaccard_join",
    "op10_suffix_dedup": "suffix_dedup",
    "op2_quality_rules": "rules",
    "op1_url_filter": "url_filter",
    "op4_quality_scores": "quality",
    "op3_vector_sharding": "sharding",
    "op7_token_counts": "token_counts",
    "op8_best_fit_packing": "packing",
    "op9_line_spread": "line_dedup",
}


def _module(name: str):
    return importlib.import_module(f"corpusloom.llm.{name}")


def queries() -> dict:
    return {name: getattr(_module(module), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in _QUERIES.items() if (sql := getattr(_module(module), "ORACLE_SQL", None))}
