"""Schemas of files that are read without looking at them first."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Usual keys of a scraped document. The time of scraping is a plain number, not an epoch.
SCRAPED = StructType(
    [StructField(n, StringType()) for n in ("title", "content", "url", "source", "doc_type")]
    + [StructField("scraped_at", DoubleType())]
)
