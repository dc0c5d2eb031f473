"""The queries of this subpackage and, where SQL expresses them, their DuckDB text."""

from __future__ import annotations

from importlib import import_module

#: Module and function of each query; the function has the query's name.
MODULES = {
    "op1_mix_sources": "op1_mixing",
    "op2_near_duplicates": "op2_near_duplicates",
    "op3_token_files": "op3_token_files",
    "op4_token_counts": "op4_token_counts",
    "op5_line_dedup": "op5_line_dedup",
    "op6_license_scan": "op6_license_scan",
    "op7_decontamination": "op7_decontamination",
    "op8_exact_top_k": "op8_exact_top_k",
    "op9_quality_scores": "op9_quality",
    "op10_secret_scan": "op10_secrets",
    "op11_collocations": "op11_collocations",
    "op12_piece_codec": "op12_pieces",
    "op13_periodic_runs": "op13_periodic_runs",
}


def queries() -> dict:
    return {name: getattr(import_module(f"taxolink.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"taxolink.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
