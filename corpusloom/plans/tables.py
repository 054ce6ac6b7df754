"""The given tables, and the frames derived from them that the registered queries work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents (text as ``content``), in enough partitions for work on their text."""
    columns = columns or ("doc_id", "source")
    docs = table(spark, sf_dir, "documents").select(*columns, F.col("text").alias("content"))
    return spread(docs, "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def derived(docs: DataFrame, expression: str) -> DataFrame:
    """Documents whose content is an SQL expression over it; both engines run the same text."""
    return docs.withColumn("content", F.expr(expression))
