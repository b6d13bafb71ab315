"""The corpus operators' queries and their DuckDB SQL, by name."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_toxicity": "toxicity",
    "op2_simhash": "simhash",
    "op3_quality": "quality",
    "op4_token_counts": "token_counts",
    "op5_pii": "pii",
    "op6_bpe": "bpe",
    "op7_mixing": "mixing",
    "op8_html_text": "html_text",
    "op9_exact_dedup": "exact_dedup",
    "op10_suffix_dedup": "suffix_dedup",
}

#: Columns of operators that SQL can express, as queries of their own.
_PARTS = {"quality_base": "quality", "pii_counts": "pii", "mix_targets": "mixing"}


def queries() -> dict:
    whole = {name: import_module(f"geostrata.llm.{m}").query for name, m in _MODULES.items()}
    return whole | {name: import_module(f"geostrata.llm.{m}").part for name, m in _PARTS.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"geostrata.llm.{m}"), "SQL", None) for name, m in _MODULES.items()}
    found |= {name: import_module(f"geostrata.llm.{m}").PART_SQL for name, m in _PARTS.items()}
    return {k: v for k, v in found.items() if v}
