"""Bit tables: which keys of a large table may be in a small one. Broadcast with a fixed bound."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 16, 1 << 25  # 8 kB to 4 MB


def bits_for(keys: int) -> int:
    """Sixty-four bits for each key, within the bounds. With fewer the table lets more through;
    whoever uses it joins with the keys themselves afterwards."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (64 * max(1, keys) - 1).bit_length()))


def bit_table(keys: DataFrame, bits: int) -> bytes:
    """A table of ``bits`` bits with those of the checksums of column ``key`` set."""
    bit = F.crc32(F.col("key").cast("binary")) % bits
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))
    words = keys.select(F.shiftright(bit, 6).alias("w"), one.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for w, v in words.collect():  # at most bits / 64 rows
        out[w] = v
    return out.tobytes()


def has_bits(keys: list[bytes], table: bytes) -> np.ndarray:
    """Whether each key may be in the table."""
    words = np.frombuffer(table, dtype=np.uint8)
    at = np.fromiter(map(zlib.crc32, keys), dtype=np.int64, count=len(keys)) % (8 * len(words))
    return (words[at >> 3] >> (at & 7)) & 1 == 1
