"""Importance resampling towards a target: hashed word features, gains by bucket, Gumbel draw.

A feature is a run of consecutive words; its bucket is the CRC-32 of its bytes. CRC-32 is linear
over XOR: with an empty register the checksum of a span is the XOR of what each byte contributes at
its distance from the end, and the full checksum adds a constant of the length. So a table of
contributions by byte and distance turns all spans of a batch into one gather and one
``bitwise_xor.reduceat``. A span longer than the table is cut into blocks from its end; each block
is moved to its place by linear operators for 1, 2, 4, ... blocks.

The corpus is read twice, once to count buckets and once to weigh documents; texts are never
shuffled. Each task sends one count per bucket. Drawing ranks narrow rows by ranges of the score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.wordbytes import slices, texts_of
from corpusloom.session import spread, written

BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
SPAN = 64  # bytes whose contribution is tabled
PIECE = 4 << 20  # longer texts are worked on piece by piece
RANKED_ROWS = 200_000  # about so many rows are ranked in one task
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


# --- checksums ------------------------------------------------------------------------------------


def _step(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The register after one more byte of zero."""
    return (state >> np.uint32(8)) ^ table[state & np.uint32(255)]


@lru_cache(maxsize=1)
def position_table() -> np.ndarray:
    """Contribution of byte b at distance d from the end, at index 256 d + b."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> np.uint32(1)) ^ np.uint32(0xEDB88320), row >> np.uint32(1))
    rows, single = [row], row
    for _ in range(SPAN - 1):
        rows.append(_step(rows[-1], single))
    return np.concatenate(rows)


@lru_cache(maxsize=40)
def _moves(power: int) -> np.ndarray:
    """What appending 2^power blocks of zeros makes of each byte of the register: four rows."""
    if power:
        half = _moves(power - 1)
        return _moved(half.ravel(), half).reshape(4, 256)
    state = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    for _ in range(SPAN):
        state = _step(state, position_table()[:256])
    return state.reshape(4, 256)


def _moved(state: np.ndarray, moves: np.ndarray) -> np.ndarray:
    out = np.zeros_like(state)
    for i in range(4):
        out ^= moves[i][(state >> np.uint32(8 * i)) & np.uint32(255)]
    return out


@lru_cache(maxsize=4096)
def _constant(length: int) -> int:
    """The checksum of so many zeros: what the length alone adds."""
    return zlib.crc32(bytes(length))


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans ``data[starts:ends]``, which may overlap and are not empty."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint32)
    lengths = ends - starts
    blocks = -(-lengths // SPAN)
    first = np.cumsum(blocks) - blocks
    back = np.repeat(first + blocks, blocks) - 1 - np.arange(blocks.sum())  # blocks behind each block
    stop = np.repeat(ends, blocks) - back * SPAN
    start = np.maximum(stop - SPAN, np.repeat(starts, blocks))
    sizes = stop - start
    at = np.cumsum(sizes) - sizes
    inside = np.arange(sizes.sum()) - np.repeat(at, sizes)
    byte = data[np.repeat(start, sizes) + inside]
    parts = position_table()[(np.repeat(sizes, sizes) - 1 - inside) * 256 + byte]
    raw = np.bitwise_xor.reduceat(parts, at)
    for power in range(int(back.max()).bit_length()):
        far = np.flatnonzero((back >> power) & 1)
        raw[far] = _moved(raw[far], _moves(power))
    raw = np.bitwise_xor.reduceat(raw, first)
    known, which = np.unique(lengths, return_inverse=True)
    return raw ^ np.array([_constant(n) for n in known.tolist()], dtype=np.uint32)[which]


# --- features -------------------------------------------------------------------------------------


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in lower-cased bytes, and its text. No word crosses texts."""
    inside = _WORD[data]
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    first = inside.copy()
    first[1:] &= ~(inside[:-1] & (text[1:] == text[:-1]))
    last = inside.copy()
    last[:-1] &= ~(inside[1:] & (text[1:] == text[:-1]))
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, text[starts]


def _pieces(data: np.ndarray, ends: np.ndarray, carried: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, ends, words that were in the piece before). Texts are whole but for a single very
    long one, which is cut between words; each piece repeats the last words of the one before."""
    if len(ends) != 1 or len(data) <= PIECE:
        yield data, ends, 0
        return
    at, before, known = 0, data[:0], 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data) and _WORD[data[stop]]:
            run = _WORD[data[stop : stop + PIECE]]
            stop += len(run) if run.all() else int(run.argmin())
        piece = np.concatenate([before, [np.uint8(32)], data[at:stop]]).astype(np.uint8)
        yield piece, np.array([len(piece)]), known
        if carried:
            starts, stops, _ = _words(piece, np.array([len(piece)]))
            known = min(carried, len(starts))
            before = piece[starts[-known] :] if known else piece[:0]
        at = stop


def features(column: pa.Array, words: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a text column: (first row, words in each row, row of each feature counted from the
    first, bucket of each feature). Features are all runs of 1 to ``words`` words, joined by a
    space. A very long text comes in several parts."""
    for start, count in slices(column):
        data, ends = texts_of(column.slice(start, count))
        for piece, stops, known in _pieces(data, ends, words - 1):
            begin, end, text = _words(piece, stops)
            totals = np.bincount(text, minlength=len(stops))
            totals[:1] -= known
            rows, found = [], []
            if words > 1:  # the words once more, with one space between them
                size = end - begin
                place = np.cumsum(size + 1) - size - 1
                joined = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                joined[np.repeat(place, size) + inside] = piece[np.repeat(begin, size) + inside]
                piece, begin, end = joined, place, place + size
            for order in range(1, words + 1):
                if len(begin) < order:
                    break
                last = np.arange(order - 1, len(begin))
                last = last[(text[last] == text[last - order + 1]) & (last >= known)]
                sums = checksums(piece, begin[last - order + 1], end[last])
                rows.append(text[last])
                found.append(sums.astype(np.int64) % buckets)
            none = np.zeros(0, dtype=np.int64)
            yield start, totals, np.concatenate([none, *rows]), np.concatenate([none, *found])


def _count(batches: Iterator[pa.RecordBatch], words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for _, _, _, found in features(batch.column(0), words, buckets):
            seen += np.bincount(found, minlength=buckets)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text", words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Features in each bucket (bucket, n), over all texts; empty buckets are left out."""
    work = partial(_count, words=words, buckets=buckets)
    parts = spread(texts.select(text)).mapInArrow(work, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the
    corpus, rounded down. Collects one row per bucket."""
    both = []
    for counts in (corpus, target):
        n = np.zeros(buckets)
        for bucket, total in counts.collect():  # at most ``buckets`` rows
            n[bucket] = total
        both.append(n)
    s, t = both
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], dtype=np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_features, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
        for start, totals, rows, found in features(batch.column(batch.num_columns - 1), words, len(gain)):
            part = slice(start, start + len(totals))
            n_words[part] += totals
            n_features[part] += np.bincount(rows, minlength=len(totals))
            weight[part] += np.bincount(rows, gain[found], len(totals)).astype(np.int64)  # exact below 2^53
        arrays = [*batch.columns[:-1], pa.array(n_words), pa.array(n_features), pa.array(weight)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "n_words", "n_features", "weight"])


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate from seed and key, rounded down. A null key counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], draw: int) -> DataFrame:
    """``rows`` with ``rank``: 1 to ``draw`` in the given order, null behind it.

    Rows are dealt to ranges of the order and written; a row's rank is its place in its range plus
    the sizes of the ranges before. No task holds more than a range, however many rows tie.
    """
    parts = max(1, math.ceil(rows.count() / RANKED_ROWS))
    dealt = written(
        rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").count()  # a row per range
    starts = sizes.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    rank = F.col("_before") + F.col("_inside")
    placed = dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_range")
    return placed.withColumn("rank", F.when(rank <= draw, rank)).drop("_range", "_inside", "_before")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    words: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """The key of every document with n_words, n_features, weight, score and rank.

    ``percent`` percent (rounded down) of the documents with at least ``min_words`` words are
    drawn, the highest scores first and of equal scores the smaller key; rank is null for all
    others. Null and empty texts have no features and weight 0. Rows with one key are weighed each;
    between rows equal in key and score any order is right. An empty target leaves every gain to
    the corpus alone; an empty table gives no rows. Further columns are ignored.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    gain = gains(
        bucket_counts(rows, "_text", words, buckets), bucket_counts(target, target_text, words, buckets), buckets
    )
    kind = rows.schema["_key"].dataType.simpleString()
    work = partial(_weigh, gain=gain, words=words)
    weighed = spread(rows).mapInArrow(work, f"_key {kind}, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("_key"), seed)), "scored")
    long = scored.where(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc("_key"), F.asc("n_features"), F.asc("weight")]
    found = ranked(long, order, percent * long.count() // 100)
    short = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return found.unionByName(short).select(
        F.col("_key").alias(key), "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")
    )


def sample(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The drawn documents, with all their columns. A null key is never drawn here, and of rows
    with one key all stay if one of them is drawn."""
    drawn = resample(docs, target, key, **options).where("rank IS NOT NULL").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(drawn, docs[key] == drawn["_drawn"], "left_semi")
