"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = (
    "search_queries", "text_queries", "chunk_queries", "store_queries", "cache_queries",
    "embed_queries", "web_queries", "prompt_queries", "metric_queries", "file_queries", "stream_queries",
)


def _collect(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"corpusloom.plans.{name}"), kind)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLE")
