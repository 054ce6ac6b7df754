"""A table fed by micro-batches: every batch is one partition, the newest row per key counts.

Writing a partition again after a failure replaces it, so a repeated batch changes nothing, and
no batch ever rewrites what is already there. A path belongs to one checkpoint: a stream that is
started afresh numbers its batches from 0 and needs a path of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
    transform: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def read_latest(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """Newest version of every key."""
    full = StructType(list(schema.fields)).add("batch", LongType())
    rows = spark.read.schema(full).parquet(path)
    every = F.struct(*[F.col(f.name) for f in schema.fields if f.name not in keys])
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"), F.desc(F.xxhash64(every)))  # ties: a fixed row
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n", "batch")


def read_documents(spark: SparkSession, path: str, schema: StructType, document: str) -> DataFrame:
    """The rows of each document from the newest batch that has any of it, so that a shorter new
    version leaves nothing of an older one behind. The newest batch of a document is found on
    narrow rows; the texts are not sorted."""
    full = StructType(list(schema.fields)).add("batch", LongType())
    rows = spark.read.schema(full).parquet(path)
    newest = rows.groupBy(document).agg(F.max("batch").alias("_newest")).withColumnRenamed(document, "_document")
    same = rows[document].eqNullSafe(newest["_document"]) & (rows["batch"] == newest["_newest"])
    return rows.join(newest, same, "left_semi").drop("batch")


def compact(spark: SparkSession, path: str, schema: StructType, keys: list[str], target: str) -> None:
    """The newest versions as one fresh table, for readers to move over to."""
    read_latest(spark, path, schema, keys).write.parquet(f"{target}/batch=0")
