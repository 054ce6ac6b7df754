"""Metadata filters and request checks as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import _col, strip


def compile_filter(spec: dict | None, column: Callable[[str], Column] = F.col) -> Column:
    """Predicate of a metadata filter.

    ``{field: value}`` is equality, ``{field: {"$in": [...]}}`` membership,
    ``{"$and": [...]}`` conjunction; several fields in one dict are a conjunction too.
    """
    terms = []
    for key, want in (spec or {}).items():
        if key == "$and":
            terms.extend(compile_filter(part, column) for part in want)
        elif isinstance(want, dict):
            unknown = set(want) - {"$in"}
            if unknown:
                raise ValueError(f"unknown filter operator: {sorted(unknown)}")
            terms.append(column(key).isin(list(want["$in"])))
        else:
            terms.append(column(key) == F.lit(want))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def resolver(df: DataFrame, metadata: str = "metadata") -> Callable[[str], Column]:
    """Top-level columns where they exist (they push down to the scan), else the metadata map."""
    names = set(df.columns)
    return lambda k: F.col(k) if k in names else F.try_element_at(F.col(metadata), F.lit(k))


def apply_filter(df: DataFrame, spec: dict | None, metadata: str = "metadata") -> DataFrame:
    return df.where(compile_filter(spec, resolver(df, metadata))) if spec else df


def request_filter(
    technology: str | None = None,
    sources: list[str] | None = None,
    required_source: str | None = None,
) -> dict | None:
    """Filter of a question: known technology, source list, and optionally one fixed source."""
    parts: list[dict] = []
    if technology in C.TECHNOLOGIES:
        parts.append({"technology": technology})
        if required_source:
            parts.append({"source": required_source})
    if sources:
        parts.append({"source": {"$in": list(sources)}})
    return {"$and": parts} if parts else None


def query_problem(c: Column | str) -> Column:
    q = _col(c)
    return (
        F.when(q.isNull() | (F.length(strip(q)) < C.MIN_QUERY_LENGTH), "too_short")
        .when(F.length(q) > C.MAX_QUERY_LENGTH, "too_long")
        .otherwise(F.lit(None).cast("string"))
    )


def _range_problem(c: Column | str, low: float, high: float) -> Column:
    v = _col(c)
    return F.when(v < low, "too_small").when(v > high, "too_large").when(v.isNull(), "missing")


def k_problem(c: Column | str, high: int = C.MAX_SEARCH_K) -> Column:
    return _range_problem(c, C.MIN_SEARCH_K, high)


def temperature_problem(c: Column | str) -> Column:
    v = _col(c)
    return F.when(F.isnan(v.cast("double")), "not_a_number").otherwise(
        _range_problem(v, C.MIN_TEMPERATURE, C.MAX_TEMPERATURE)
    )


def max_tokens_problem(c: Column | str) -> Column:
    return _range_problem(c, C.MIN_MAX_TOKENS, C.MAX_MAX_TOKENS)


def clamp_k(k: Column | str, overlap: Column | int = C.DEFAULT_K_OVERLAP) -> Column:
    extra = overlap if isinstance(overlap, Column) else F.lit(overlap)
    return F.least(_col(k) + extra, F.lit(C.MAX_SEARCH_K))


def cacheable_response(c: Column | str) -> Column:
    return F.coalesce(F.length(_col(c)) >= C.MIN_RESPONSE_LENGTH, F.lit(False))


def cacheable_text(c: Column | str) -> Column:
    return F.coalesce(F.length(_col(c)) >= C.MIN_EMBED_TEXT_LENGTH, F.lit(False))


def not_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def file_problem(extension: Column, content: Column) -> Column:
    """Gate for an uploaded file: known suffix, size, and a content signature that is allowed.

    PDF, zipped office formats and OLE files are known by their first bytes; anything else has
    to be text, that is, free of NUL bytes.
    """
    magic = F.hex(F.substring(content, 1, 4))
    known = magic.isin("25504446", "504B0304", "D0CF11E0")
    textual = ~F.contains(content, F.lit(bytearray(b"\x00")))
    return (
        F.when(~extension.isin(*C.FORMATS), "unsupported_type")
        .when(F.octet_length(content) > C.MAX_FILE_BYTES, "too_large")
        .when(~(known | textual), "bad_content")
        .otherwise(F.lit(None).cast("string"))
    )
