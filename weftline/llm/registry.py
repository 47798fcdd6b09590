"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

import importlib

from . import oracles

#: query name -> module of this subpackage that defines it
MODULES = {
    "op1_best_fit_packing": "packing",
    "op2_minhash_near_dedup": "near",
    "op3_substring_dedup": "substring",
    "op4_arc_to_warc": "archive",
    "op5_toxicity_ftrl": "toxicity",
    "op6_language_id": "language",
    "op7_token_counts": "lengths",
    "op8_media_columns": "media",
    "op9_chat_formatting": "chat",
    "op10_decontamination": "decontaminate",
    "op11_quality_rules": "quality",
    "op12_token_alignment": "alignment",
    "op13_periodic_runs": "periodic",
}


def _load(name: str):
    return getattr(importlib.import_module(f"{__package__}.{MODULES[name]}"), name)


def queries() -> dict:
    import corpus_pipeline

    return {**{name: _load(name) for name in MODULES}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {**oracles.SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
