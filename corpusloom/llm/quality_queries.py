"""The registered query of the quality rules. Its trees have no SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import quality
from corpusloom.plans.tables import table


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept", "chance")
