"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import importlib

import corpus_pipeline

# query: module that defines it; its SQL twin, where there is one, is named OP<N>_SQL there.
MODULES = {
    "op1_near_duplicates": "document_queries",
    "op2_pii": "document_queries",
    "op3_lm_score": "document_queries",
    "op4_decontamination": "text_queries",
    "op5_packing": "document_queries",
    "op6_language_id": "document_queries",
    "op7_url_filter": "url_queries",
    "op8_sharding": "document_queries",
    "op9_licenses": "text_queries",
    "op10_nearest": "vector_queries",
    "op11_resampling": "resampling_queries",
    "op12_quality": "quality_queries",
    "op13_alignment": "token_queries",
}


def queries() -> dict:
    out = {name: getattr(importlib.import_module(f"corpusloom.llm.{m}"), name) for name, m in MODULES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracles() -> dict:
    out = {}
    for name, m in MODULES.items():
        sql = getattr(importlib.import_module(f"corpusloom.llm.{m}"), name.split("_")[0].upper() + "_SQL", None)
        if sql is not None:
            out[name] = sql
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
