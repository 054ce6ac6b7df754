"""The registered query of tokenizer alignment. Tokenizers have no SQL twin."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import alignment
from corpusloom.plans.tables import table

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = alignment.align(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)
    return found
