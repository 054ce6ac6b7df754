"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets small enough for memory: the shard comes from the key
and the number of shards alone (highest of one hash per shard, so one more shard takes rows only
into itself), the bucket within the shard from a seeded hash of key and content. Pass two takes
each bucket into memory, brings it into a fixed order and shuffles it by Fisher-Yates with a
generator seeded by the bucket, so that a repeated task gives the same order. A record's slot is
the size of the buckets before its own plus its place in the bucket.

Copies of one text under many keys spread over all buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

BUCKET_BYTES = 16 << 20  # expected text in a bucket
_ADDED = ("shard", "slot", "grown_shard", "_bucket", "_content", "_before")


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard, 0 to ``shards - 1``, with the highest hash of seed, key and shard."""
    scores = F.array(*[F.xxhash64(F.lit(seed), key, F.lit(s)) for s in range(shards)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def fisher_yates(count: int, rng: np.random.Generator) -> np.ndarray:
    """A random order of 0 to ``count - 1``."""
    order = list(range(count))
    draws = (rng.random(count) * np.arange(1, count + 1)).astype(np.int64).tolist()
    for i in range(count - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _shuffled(rows: pa.Table, before: pa.Table, key: str, seed: int, columns: list[str]) -> pa.Table:
    shard, bucket = rows["shard"][0].as_py(), rows["_bucket"][0].as_py()
    rows = rows.sort_by([(key, "ascending"), ("_content", "ascending")])
    rng = np.random.default_rng([seed, shard, bucket])
    place = fisher_yates(rows.num_rows, rng)  # the row at i comes from place[i]
    start = before["_before"][0].as_py()
    rows = rows.take(pa.array(place))
    rows = rows.append_column("slot", pa.array(np.arange(start, start + rows.num_rows)))
    return rows.select(columns)


def external_shuffle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = 8,
    seed: int = 0,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Every row of ``docs`` with shard, slot (gapless from 0 in its shard) and grown_shard (the
    shard if there were one more).

    Null keys count as one key, null texts as empty. Rows equal in key and text lie in one bucket;
    which of them comes first is open. Input columns that have a name of the three are replaced.
    An empty table gives no rows.
    """
    taken = {c.lower() for c in _ADDED}
    kept = [c for c in docs.columns if c.lower() not in taken]
    rows = docs.select(*kept)
    total = rows.agg(F.sum(F.octet_length(text) + F.lit(1))).first()[0] or 0
    per_shard = max(1, math.ceil(total / shards / bucket_bytes))
    rows = rows.withColumns({
        "shard": shard_of(F.col(key), shards, seed),
        "grown_shard": shard_of(F.col(key), shards + 1, seed),
        "_content": F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))),
    })
    rows = rows.withColumn(
        "_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), "_content"), F.lit(per_shard)).cast("int")
    )
    sizes = rows.groupBy("shard", "_bucket").count()
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("shard", "_bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    columns = [*kept, "shard", "slot", "grown_shard"]
    schema = StructType([
        *docs.select(*kept).schema.fields,
        StructField("shard", IntegerType()), StructField("slot", LongType()), StructField("grown_shard", IntegerType()),
    ])
    return rows.groupBy("shard", "_bucket").cogroup(before.groupBy("shard", "_bucket")).applyInArrow(
        lambda bucket, before: _shuffled(bucket, before, key, seed, columns), schema
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; the rows of a file stand in the order of their slots."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
