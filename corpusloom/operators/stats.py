"""Statistics over chunks, ingest runs and request logs: aggregations with map-side partials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import batch_tier


def chunk_stats(chunks: DataFrame, text_col: str = "content") -> DataFrame:
    """One row: chunks, mean, longest, shortest content, mean words."""
    size = F.length(text_col)
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        F.avg(size).alias("avg_chunk_size"),
        F.max(size).cast("bigint").alias("max_chunk_size"),
        F.min(size).cast("bigint").alias("min_chunk_size"),
        F.avg("word_count").alias("avg_word_count"),
    )


def chunk_counts(chunks: DataFrame, type_col: str = "chunk_type", source_col: str = "source") -> DataFrame:
    """Chunks by type, by source, and in all, in one pass."""
    kind = F.coalesce(F.col(type_col), F.lit("unknown")).alias("chunk_type")
    source = F.coalesce(F.col(source_col), F.lit("unknown")).alias("source")
    view = chunks.select(kind, source)
    return view.groupingSets(
        [["chunk_type"], ["source"], []], "chunk_type", "source"
    ).agg(F.count("*").alias("chunks"), F.grouping_id().cast("bigint").alias("grouping"))


def ingest_summary(results: DataFrame, ok: str = "success", by: list[str] | None = None) -> DataFrame:
    """Documents that went well and that failed."""
    return results.groupBy(*(by or [])).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col(ok)).alias("succeeded"),
        F.count_if(~F.col(ok)).alias("failed"),
    )


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("total"))


def token_totals(events: DataFrame, label: str, prompt: str, completion: str) -> DataFrame:
    """Tokens by label and kind: two sums in one pass, then turned into rows."""
    sums = events.groupBy(label).agg(
        F.sum(prompt).alias("prompt"), F.sum(completion).alias("completion")
    )
    return sums.unpivot([label], ["prompt", "completion"], "token_type", "tokens")


def latency_histogram(
    events: DataFrame, labels: list[str], seconds: str, buckets: tuple[float, ...] = C.LATENCY_BUCKETS
) -> DataFrame:
    """Cumulative bucket counts with total and sum. Every bucket is one conditional count of a
    single aggregation; rows are made from the few aggregated ones, not from the events."""
    counts = [F.count_if(F.col(seconds) <= b).alias(f"_{i}") for i, b in enumerate(buckets)]
    wide = events.groupBy(*labels).agg(
        *counts, F.count(seconds).alias("count"), F.sum(seconds).alias("sum")
    )
    rows = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("n"))
        for i, b in enumerate(buckets)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return wide.select(*labels, "count", "sum", F.inline(F.array(*rows))).select(
        *labels, "le", F.col("n").alias("bucket_count"), "count", "sum"
    )


def gauges(events: DataFrame, labels: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """Latest value per label, null labels included; of several at the same moment the one with
    the highest ``tie``. One aggregation with map-side partials."""
    return events.groupBy(*labels).agg(F.max_by(value, F.struct(ts, tie)).alias("value"))


def batch_sizes(docs: DataFrame, source_col: str, id_col: str, text_col: str, first: int = 100) -> DataFrame:
    """Batch size per source from the mean length of its first texts."""
    w = Window.partitionBy(source_col).orderBy(id_col)
    head = docs.select(source_col, id_col, F.length(text_col).alias("_len"))
    head = head.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    mean = head.groupBy(source_col).agg(F.avg("_len").alias("mean_length"))
    return mean.withColumn("batch_size", batch_tier("mean_length").cast("bigint"))


def allowed_calls(endpoint: str, limits: dict[str, int]):
    pairs = [F.lit(x) for kv in limits.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(endpoint)).cast("bigint")


def rate_breaches(
    requests: DataFrame, client: str, endpoint: str, ts: str, limits: dict[str, int], unit: str = "minute"
) -> DataFrame:
    """Clients with more calls of an endpoint in a fixed window than its limit allows."""
    start = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("window_start")
    calls = requests.where(F.col(endpoint).isin(*limits)).groupBy(client, endpoint, start)
    out = calls.agg(F.count("*").alias("calls")).withColumn("allowed", allowed_calls(endpoint, limits))
    return out.where(F.col("calls") > F.col("allowed"))
