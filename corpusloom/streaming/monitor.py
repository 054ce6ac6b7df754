"""Live request metrics: counts, latency histogram and rate-limit breaches per window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructType

from corpusloom import constants as C
from corpusloom.operators.stats import allowed_calls
from corpusloom.streaming.sink import write_batches


def timed(events: DataFrame, late: str | None, ts: str = "ts") -> DataFrame:
    """Events with a zoned time. ``late`` is how far a row may lie behind the newest one: later
    ones are dropped, and the state of older windows is freed. With None no row is ever dropped
    and all windows stay in the state: for stored tables, whose files come in any order."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events if late is None else events.withWatermark(ts, late)


def windowed_counts(events: DataFrame, labels: list[str], width: str = "1 hour", ts: str = "ts") -> DataFrame:
    return events.groupBy(F.window(F.col(ts), width), *labels).agg(F.count("*").alias("total")).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), *labels, "total"
    )


def windowed_latency(
    events: DataFrame, labels: list[str], seconds: str, width: str = "1 hour", ts: str = "ts",
    buckets: tuple[float, ...] = C.LATENCY_BUCKETS,
) -> DataFrame:
    """Cumulative bucket counts as columns, with count and sum."""
    counts = [F.count_if(F.col(seconds) <= b).alias(f"le_{b}".replace(".", "_")) for b in buckets]
    out = events.groupBy(F.window(F.col(ts), width), *labels).agg(
        *counts, F.count(seconds).alias("count"), F.sum(seconds).alias("sum")
    )
    return out.withColumn("window_start", F.col("window.start").cast("timestamp_ntz")).drop("window")


def breaches(
    events: DataFrame, client: str, endpoint: str, limits: dict[str, int], width: str = "1 minute", ts: str = "ts"
) -> DataFrame:
    """Clients over the limit of an endpoint, reported as soon as they are."""
    calls = events.where(F.col(endpoint).isin(*limits)).groupBy(
        F.window(F.col(ts), width), client, endpoint
    ).agg(F.count("*").alias("calls"))
    out = calls.withColumn("allowed", allowed_calls(endpoint, limits)).where("calls > allowed")
    return out.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), client, endpoint, "calls", "allowed"
    )


# --- alerts with state of their own ---------------------------------------------------------------


def _calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls counted before the shuffle, so that a busy client sends a few rows per task."""
    for batch in batches:
        if batch.num_rows:
            names = batch.schema.names
            counted = pa.Table.from_batches([batch]).group_by(names).aggregate([([], "count_all")])
            yield from counted.select([*names, "count_all"]).rename_columns([*names, "_n"]).combine_chunks().to_batches()


ALERT_GROUPS = 1024  # clients and endpoints share so many states


def breach_alerts(
    events: DataFrame, client: str, endpoint: str, limits: dict[str, int], late: str,
    width: str = "1 minute", ts: str = "ts", groups: int = ALERT_GROUPS,
) -> DataFrame:
    """One row for each window in which a client goes over the limit of an endpoint, in the batch in
    which that happens, and none after it. For append mode.

    The state of a client and endpoint are the counts of its open windows. A window is closed, its
    count freed and further calls of it left out, once a window that ends ``late`` later has been
    seen; a time-out frees what no call asks for any more. Endpoints without a limit, and calls
    without a client or a time, are left out.

    Calling Python once for each client and endpoint takes far longer than counting, so those of one
    hash share a state and a call: the number of calls does not grow with the clients. More
    ``groups`` make smaller states; a checkpoint keeps to the number that it began with.
    """
    span = F.window(F.col(ts).cast("timestamp"), width)
    known = events.where(F.col(endpoint).isin(*limits) & F.col(client).isNotNull() & F.col(ts).isNotNull())
    calls = known.select(
        F.col(client).alias("_client"), F.col(endpoint).alias("_endpoint"), allowed_calls(endpoint, limits).alias("_allowed"),
        span.alias("_span"),
    )
    calls = calls.select(
        "_client", "_endpoint", "_allowed", F.unix_micros("_span.start").alias("_start"), F.col("_span.end").alias("_end"),
        F.unix_millis("_span.end").alias("_until"),
    )
    kinds = dict(calls.dtypes)
    who = f"_client {kinds['_client']}, _endpoint {kinds['_endpoint']}"
    counted = calls.mapInArrow(_calls, f"{who}, _allowed long, _start long, _end timestamp, _until long, _n long")
    group = F.pmod(F.xxhash64("_client", "_endpoint"), F.lit(groups)).cast("int")
    counted = counted.withColumn("_group", group).withWatermark("_end", late)
    read = ["_client", "_endpoint", "_start", "_n", "_until", "_allowed"]

    def track(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts: dict[tuple, tuple[int, int]] = {(c, e, s): (n, end) for c, e, s, n, end in zip(*state.get)} if state.exists else {}
        told = []
        for part in parts:
            for who, where, start, n, end, allowed in zip(*(part[c].tolist() for c in read)):
                before = counts.get((who, where, start), (0, 0))[0]
                counts[who, where, start] = (before + n, end)
                if before <= allowed < before + n:
                    told.append((start, who, where, allowed))
        closed = state.getCurrentWatermarkMs()
        open_ = [(*at, n, end) for at, (n, end) in counts.items() if end > closed]
        if open_:
            state.update(tuple(list(c) for c in zip(*open_)))
            state.setTimeoutTimestamp(min(row[-1] for row in open_))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(told, columns=["_start", "_client", "_endpoint", "_allowed"])

    alerts = counted.groupBy("_group").applyInPandasWithState(
        track, f"_start long, {who}, _allowed long",
        f"clients array<{kinds['_client']}>, endpoints array<{kinds['_endpoint']}>, starts array<long>, counts array<long>, ends array<long>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    return alerts.select(
        F.timestamp_micros("_start").cast("timestamp_ntz").alias("window_start"),
        F.col("_client").alias(client), F.col("_endpoint").alias(endpoint), F.col("_allowed").alias("allowed"),
    )


# --- final windows and what came too late ----------------------------------------------------------


def write_final(
    events: DataFrame, labels: list[str], late: str, path: str, checkpoint: str, width: str = "1 hour",
    ts: str = "ts", **options,
) -> list[StreamingQuery]:
    """Two streams over ``events``: windows that are final (append mode; state ends with them), in
    ``path/final``, and the counts of all that arrived, batch by batch and without state, in
    ``path/arrived``. What is in the second and not in the first came too late or is still open."""
    counts = windowed_counts(timed(events, late, ts), labels, width, ts)
    zoned = timed(events, None, ts)

    def arrived(batch: DataFrame) -> DataFrame:
        newest = F.max(F.col(ts)).cast("timestamp_ntz").alias("newest")
        out = batch.groupBy(F.window(F.col(ts), width), *labels).agg(F.count("*").alias("total"), newest)
        edges = [F.col(f"window.{e}").cast("timestamp_ntz").alias(f"window_{e}") for e in ("start", "end")]
        return out.select(*edges, *labels, "total", "newest")

    return [
        write_batches(counts, f"{path}/final", f"{checkpoint}/final", "append", **options),
        write_batches(zoned, f"{path}/arrived", f"{checkpoint}/arrived", "append", transform=arrived, **options),
    ]


def final_counts(spark: SparkSession, path: str, labels: StructType) -> DataFrame:
    """The windows that are final; ``labels`` are the fields of the labels."""
    schema = StructType.fromDDL("window_start timestamp_ntz")
    schema = StructType([*schema.fields, *labels.fields]).add("total", LongType())
    return spark.read.schema(schema).parquet(f"{path}/final").drop("batch")


def late_counts(spark: SparkSession, path: str, labels: StructType, late: str) -> DataFrame:
    """Rows that came too late for their window, by window: those that arrived and are not in its
    final count, of windows that are closed. For after both streams have taken in the same files."""
    edges = StructType.fromDDL("window_start timestamp_ntz, window_end timestamp_ntz")
    rest = StructType.fromDDL("total long, newest timestamp_ntz")
    schema = StructType([*edges.fields, *labels.fields, *rest.fields])
    rows = spark.read.schema(schema).parquet(f"{path}/arrived")
    keys = ["window_start", "window_end", *labels.names]
    both = rows.groupBy(*keys).agg(F.sum("total").alias("total"))
    closed = rows.agg(F.max("newest") - F.expr(f"INTERVAL {late}")).scalar()
    done = final_counts(spark, path, labels).withColumnRenamed("total", "_final")
    same = [both["window_start"] == done["window_start"]] + [both[c].eqNullSafe(done[c]) for c in labels.names]
    joined = both.join(done, same, "left").select(*[both[c] for c in keys], "total", "_final")
    return joined.where(F.col("window_end") <= closed).select(
        "window_start", *labels.names, (F.col("total") - F.coalesce("_final", F.lit(0))).alias("late")
    ).where("late > 0")
