"""Merging hit lists: web results after vector hits, and the first provider that answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as C


def top_hits(hits: DataFrame, n: int) -> DataFrame:
    return hits.where(F.col("rank") <= n)


def cap_results(results: DataFrame, n: int, query_id: str = "query_id", order: str = "position") -> DataFrame:
    """First n results per question and provider, in their own order."""
    w = Window.partitionBy(query_id, "provider").orderBy(order)
    out = results.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return out.where(F.col("rank") <= n)


def first_provider(
    results: DataFrame, n: int = C.WEB_RESULTS_PER_QUESTION, query_id: str = "query_id",
    order: str = "position", providers: tuple[str, ...] = C.WEB_PROVIDERS,
) -> DataFrame:
    """Per question the results of the first provider that has any; results of providers that are
    not listed count only where no listed one has any.

    The cap per provider comes first and runs before the shuffle, so the window over a question
    sees no more than n rows per provider.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in providers]), F.col("provider"))
    tried = F.when(place > 0, place).otherwise(F.lit(len(providers) + 1))
    capped = cap_results(results, n, query_id, order).withColumn("_try", tried)
    best = F.min("_try").over(Window.partitionBy(query_id))
    return capped.withColumn("_best", best).where(F.col("_try") == F.col("_best")).drop("_try", "_best")


def append_hits(hits: DataFrame, more: DataFrame, query_id: str = "query_id") -> DataFrame:
    """``more`` (ranked from 1) behind ``hits`` per question; ranks go on, nothing is re-sorted."""
    counts = hits.groupBy(query_id).agg(F.count("*").alias("_n"))
    moved = more.join(counts, query_id, "left").withColumn(
        "rank", (F.col("rank") + F.coalesce("_n", F.lit(0))).cast("bigint")
    )
    return hits.unionByName(moved.drop("_n"), allowMissingColumns=True)


def merge_sources(*frames: DataFrame) -> DataFrame:
    """Document sources with differing columns, one below the other."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
