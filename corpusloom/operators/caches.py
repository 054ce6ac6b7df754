"""Caches as tables: lookups, eviction, statistics, persistence.

A cache is a frame of ``key`` (hex digest), a value column, ``created_at``, ``accessed_at``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.operators.joins import lookup_join, split_at
from corpusloom.session import written


def lookup(
    rows: DataFrame, cache: DataFrame, value: str, ttl_seconds: float | None = None, now=None
) -> DataFrame:
    """Rows with the cached value and a ``hit`` flag. Entries older than ``ttl_seconds`` at
    ``now`` count as missing; by default entries do not expire."""
    if ttl_seconds is not None:
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        age = (F.unix_micros(at) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
        cache = cache.where(age <= ttl_seconds)
    table = cache.select("key", F.col(value), F.lit(True).alias("hit"))
    return lookup_join(rows, table, "key").withColumn("hit", F.coalesce("hit", F.lit(False)))


def hit_rate(lookups: DataFrame, by: list[str] | None = None) -> DataFrame:
    out = lookups.groupBy(*(by or [])).agg(
        F.count("*").alias("lookups"), F.count_if("hit").alias("hits")
    )
    return out.withColumn("hit_rate", F.lit(100.0) * F.col("hits") / F.col("lookups"))


def keep_recent(cache: DataFrame, limit: int = C.RESPONSE_CACHE_SIZE) -> DataFrame:
    """The ``limit`` most recently used entries (the answer cache drops one per new entry)."""
    surplus = cache.count() - limit
    return cache if surplus <= 0 else split_at(cache, surplus, "accessed_at", "key")[1]


def evict_oldest(cache: DataFrame, limit: int = C.EMBEDDING_CACHE_SIZE) -> DataFrame:
    """When the cache is full, drop its least recently used tenth, at least one entry."""
    entries = cache.count()
    if entries < limit:
        return cache
    return split_at(cache, max(1, entries // 10), "accessed_at", "key")[1]


def size_after(entries: int, added: int, limit: int, drop: int) -> int:
    """Entries after new keys were added one by one to a cache that drops ``drop`` entries
    whenever it is full. A cache above its limit is cut to it first."""
    room = max(0, limit - entries)
    if added <= room:
        return entries + added
    return limit - drop + 1 + (added - room - 1) % drop


def store(cache: DataFrame, new: DataFrame, limit: int, drop: int | None = None) -> DataFrame:
    """Cache with entries (unique by key) added or overwritten, as if one by one: overwriting
    never evicts, a new key in a full cache drops the ``drop`` least recently used entries (a
    tenth of the limit unless given; the answer cache drops one). Only the newest are ever kept,
    so the result is the newest of all, as many as are left in the end. Entries without a time
    of access count as oldest."""
    drop = max(1, limit // 10 if drop is None else drop)
    old = written(cache.join(new.select("key"), "key", "left_anti"), "cache")
    both = written(old.unionByName(new), "cache")
    total, entries = both.count(), cache.count()
    added = total - entries
    surplus = total - (size_after(entries, added, limit, drop) if added else total)
    return both if surplus <= 0 else split_at(both, surplus, "accessed_at", "key")[1]


def touch(cache: DataFrame, lookups: DataFrame, at: str = "at") -> DataFrame:
    """The cache after lookups (key, at): an entry that was asked for counts as used at the time
    of its last lookup."""
    last = lookups.groupBy("key").agg(F.max(at).alias("_at"))
    used = F.greatest("accessed_at", "_at")  # the one that is there, if one is null
    return lookup_join(cache, last, "key").withColumn("accessed_at", used).select(cache.columns)


def cache_stats(cache: DataFrame, max_size: int, value: str | None = None) -> DataFrame:
    """One row: entries, limit, oldest, newest, and where known mean text length and size."""
    aggs = [
        F.count("*").alias("total_entries"),
        F.lit(max_size).cast("bigint").alias("max_size"),
        F.min("created_at").alias("oldest_entry"),
        F.max("created_at").alias("newest_entry"),
    ]
    if "text_length" in cache.columns:
        aggs.append(F.coalesce(F.avg("text_length"), F.lit(0.0)).alias("avg_text_length"))
    if value:
        size = F.sum(F.octet_length(F.col(value).cast("string"))) / F.lit(1024.0 * 1024.0)
        aggs.append(F.coalesce(size, F.lit(0.0)).alias("cache_size_mb"))
    return cache.agg(*aggs)


def save(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").parquet(path)


def load(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def clear(cache: DataFrame, path: str | None = None) -> DataFrame:
    """The empty cache; with a path the stored one is replaced by it."""
    empty = cache.sparkSession.createDataFrame([], cache.schema)
    if path:
        save(empty, path)
    return empty


# --- a stored cache that stays where it is ----------------------------------------------------------


def _table_name(path: str) -> str:
    return f"corpusloom_cache_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def save_bucketed(cache: DataFrame, path: str, buckets: int = 64, mode: str = "errorifexists") -> DataFrame:
    """Write a cache dealt out and sorted by key, so that lookups need not move it. ``append`` adds
    entries with new keys to a cache that has been written so."""
    name = _table_name(path)
    writer = cache.write.mode(mode).format("parquet").bucketBy(buckets, "key").sortBy("key")
    if mode == "append":
        open_bucketed(cache.sparkSession, path, cache.schema, buckets)
        writer.saveAsTable(name)
    else:
        writer.option("path", path).saveAsTable(name)
    return cache.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, schema, buckets: int = 64) -> DataFrame:
    """A cache written by :func:`save_bucketed`, also by another application; schema and number of
    buckets are those that it was written with."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(name)


def lookup_bucketed(rows: DataFrame, cache: DataFrame, value: str, buckets: int = 64) -> DataFrame:
    """As :func:`lookup`, from a bucketed cache, which is read where it lies. Each key that is asked
    for goes to its bucket once, however many rows ask; only the entries found come back to them."""
    keys = rows.select("key").where(F.col("key").isNotNull()).distinct().repartition(buckets, "key")
    found = keys.join(cache.select("key", F.col(value)).hint("merge"), "key").withColumn("hit", F.lit(True))
    return lookup_join(rows, found, "key").withColumn("hit", F.coalesce("hit", F.lit(False)))
