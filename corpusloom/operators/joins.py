"""Joins and cuts that hold when one key, or one moment, has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import written

HOT_SAMPLE = 0.01
HOT_LIMIT = 1000  # keys that may be treated as hot: bounds what is broadcast
HOT_ROWS = 1000  # sampled rows that make a key hot, about 100 000 rows in all
SMALL_ROWS = 1_000_000  # narrow rows that may be broadcast
CUT_ROWS = 100_000  # rows that may be sorted in one place
_CUT_BUCKETS = 1000


def hot_keys(rows: DataFrame, key: str) -> list:
    """Keys seen very often in a sample. Only a hint for the join strategy: results do not
    depend on it."""
    seen = rows.select(key).where(F.col(key).isNotNull()).sample(HOT_SAMPLE, seed=1)
    many = seen.groupBy(key).count().where(F.col("count") >= HOT_ROWS)
    return [r[0] for r in many.orderBy(F.desc("count")).limit(HOT_LIMIT).collect()]


def small_side(rows: DataFrame, label: str) -> tuple[DataFrame, int]:
    """A narrow side of a join, written down and counted: broadcast only when it is small.

    Left to itself a join against a table of any size would start to shuffle that table before
    the size of this side is known.
    """
    kept = written(rows, label)
    count = kept.count()
    return (F.broadcast(kept) if count <= SMALL_ROWS else kept), count


def _splits_skew(rows: DataFrame) -> bool:
    conf = rows.sparkSession.conf
    return all(
        conf.get(f"spark.sql.adaptive.{name}") == "true" for name in ("enabled", "skewJoin.enabled")
    )


def lookup_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to a table with unique ``key``.

    A key with very many rows is split at run time by adaptive execution. Where that is switched
    off, hot keys are found in a sample: their rows meet their at most ``HOT_LIMIT`` table rows
    by broadcast and stay where they are, and only the others are shuffled.
    """
    hot = [] if _splits_skew(rows) else hot_keys(rows, key)
    if not hot:
        return rows.join(table, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(table.where(F.col(key).isin(hot)))
    rest = rows.where(~is_hot).join(table.where(~is_hot), key, "left")
    return rows.where(is_hot).join(few, key, "left").unionByName(rest)


def latest_per_key(rows: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """Last row per key; ``ties`` decide between equal ``order``, and then a hash of the row. The
    window limit runs before the shuffle too, so a hot key sends one row per task."""
    whole = F.xxhash64(*[F.to_json(F.struct(F.col(c))) if "map" in t else F.col(c) for c, t in rows.dtypes])
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in (order, *ties)], F.desc(whole))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def _cut_point(rows: DataFrame, value: Column, n: int) -> tuple[int, int, int] | None:
    """Narrow down where the n-th smallest value lies, by counting equal-width buckets.

    Returns (low, high, rows below low) with the n-th row at a value in [low, high]. Each round
    is one aggregation over the table and brings at most ``_CUT_BUCKETS`` counts back.
    """
    low, high, total = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if total <= n:
        return None
    below, inside = 0, total
    while low < high and inside > CUT_ROWS:
        width = max(1, -(-(high - low + 1) // _CUT_BUCKETS))
        bucket = F.floor((value - F.lit(low)) / F.lit(width)).cast("int")
        part = rows.where(value.between(low, high)).groupBy(bucket.alias("b")).count()
        for b, count in sorted(part.collect()):
            if below + count > n:
                low, high, inside = low + b * width, min(high, low + (b + 1) * width - 1), count
                break
            below += count
    return low, high, below


def split_at(rows: DataFrame, n: int, time_col: str, key_col: str) -> tuple[DataFrame, DataFrame]:
    """(first n rows by time and then key, all others), with no global sort.

    Keys are fixed-length lower-case hex digests, so their first 15 digits order as numbers;
    that is how a single moment shared by very many rows is cut as well.
    """
    # Rows without a time come before all others.
    moment = F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(-(1 << 60)))
    digest = F.conv(F.substring(key_col, 1, 15), 16, 10).cast("bigint")
    cut = _cut_point(rows, moment, n)
    if cut is None:
        return rows, rows.limit(0)
    low, high, below = cut
    head, tail, middle = moment < low, moment > high, moment.between(low, high)
    left = n - below
    if low == high:
        inner = _cut_point(rows.where(middle), digest, left)
        if inner is None:
            return rows.where(~tail), rows.where(tail)
        low2, high2, below2 = inner
        head = head | (middle & (digest < low2))
        tail = tail | (middle & (digest > high2))
        middle = middle & digest.between(low2, high2)
        left -= below2
    edge = rows.where(middle).orderBy(time_col, key_col)
    first = rows.where(head).unionByName(edge.limit(left))
    rest = rows.where(tail).unionByName(edge.offset(left))
    return first, rest


def numbered(rows: DataFrame, group: str, order: str, out: str, block: int = 100_000) -> DataFrame:
    """Running number from 1 within each group (null is one), by an integer column that is unique
    in it.

    A group is ranked in blocks of its order values, and each block adds the number of rows in
    the blocks before it: no task holds more than one block, however large the group is.
    """
    cut = rows.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    sizes = cut.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("_group"), F.col("_block").alias("_of"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
    )
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy(order))
    same = F.col(group).eqNullSafe(F.col("_group")) & F.col("_block").eqNullSafe(F.col("_of"))
    ranked = cut.withColumn("_in", inside).join(starts, same)
    return ranked.withColumn(out, (F.col("_start") + F.col("_in")).cast("bigint")).drop(
        "_block", "_in", "_start", "_group", "_of"
    )
