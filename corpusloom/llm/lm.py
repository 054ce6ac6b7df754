"""Language-model scoring with a weighted backoff automaton.

An n-gram model with Dirichlet-smoothed probabilities (the shorter context's distribution is the
prior) is read as an automaton: contexts seen in training are states, seen n-grams are weighted
arcs, and a state without an arc for the next word takes its failure arc to the shorter context at
a weight. One pass over the words from left to right carries the state and adds log-probabilities.

The model is never in one place. Documents lie in buckets of bounded bytes. Each bucket sends the
n-grams it has, once each, with its training counts, to ranges of their hash; a range adds up and
sends each bucket the totals of just its n-grams, in the order it sent them. So each bucket gets
the part of the automaton that its documents can reach. What is shuffled is one sorted array per
bucket and range, pre-aggregated, so frequent words weigh no more than rare ones.

N-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.wordbytes import chain, mix, slices, texts_of, word_hashes
from corpusloom.session import spread

ORDER = 2
PRIOR = 50.0  # weight of the shorter context's distribution, in words
ADDED = 0.1  # to each count of a single word
BUCKET_BYTES = 5 << 20
RANGE_BYTES = 16 << 20  # text whose n-grams meet in a range, about
START, END = mix(np.arange(1, 3, dtype=np.uint64) << np.uint64(60))
_PLANES = "keys binary, counts binary"


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: mostly zeros, which the shuffle compresses away."""
    width = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, width).T.tobytes()


def _values(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_values(data, np.uint64), dtype=np.uint64)


class Grams:
    """The n-grams of some documents. ``words`` has START before and END after each document's
    words; position i of ``keys[k]`` is the hash of the k words that end there."""

    def __init__(self, texts: pa.ChunkedArray, order: int):
        parts, counts = [], []
        for chunk in texts.chunks:
            data, ends = texts_of(chunk)
            hashes, count = word_hashes(data, ends)
            parts.append(hashes)
            counts.append(count)
        hashes, self.lengths = np.concatenate(parts), np.concatenate(counts)
        last = np.cumsum(self.lengths + 2) - 1
        self.first = last - self.lengths - 1  # where START is
        self.words = np.empty(len(hashes) + 2 * len(last), dtype=np.uint64)
        edge = np.zeros(len(self.words), dtype=bool)
        edge[self.first] = edge[last] = True
        self.words[~edge] = hashes
        self.words[self.first], self.words[last] = START, END
        self.depth = np.arange(len(self.words)) - np.repeat(self.first, self.lengths + 2)  # words before
        self.keys = {1: self.words}
        for k in range(2, order + 1):
            keys = np.zeros(len(self.words), dtype=np.uint64)
            keys[1:] = chain(self.keys[k - 1][:-1], self.words[1:])
            self.keys[k] = keys

    def counted(self, k: int) -> np.ndarray:
        """Positions at which an n-gram of k words ends; START alone is none."""
        return np.flatnonzero(self.depth >= max(1, k - 1))


def _range_ends(ranges: int) -> np.ndarray:
    return np.array([((r + 1) << 64) // ranges - 1 for r in range(ranges)], dtype=np.uint64)


def _count(rows: pa.Table, order: int, ranges: int) -> pa.Table:
    """The distinct n-grams of a bucket with their counts in its training documents."""
    grams = Grams(rows["text"], order)
    train = np.repeat(~rows["held"].to_numpy(zero_copy_only=False), grams.lengths + 2)
    out = {"k": [], "r": [], "g": [], "keys": [], "counts": []}
    bucket = rows["g"][0].as_py()
    for k in range(1, order + 1):
        at = grams.counted(k)
        keys, inverse = np.unique(grams.keys[k][at], return_inverse=True)
        counts = np.bincount(inverse, weights=train[at], minlength=len(keys)).astype(np.uint32)
        cuts = np.searchsorted(keys, _range_ends(ranges), side="right")
        start = 0
        for r, stop in enumerate(cuts):
            if stop > start:
                out["k"].append(k)
                out["r"].append(r)
                out["g"].append(bucket)
                out["keys"].append(_pack_keys(keys[start:stop]))
                out["counts"].append(_planes(counts[start:stop]))
            start = stop
    return pa.table({
        "k": pa.array(out["k"], pa.int32()), "r": pa.array(out["r"], pa.int32()), "g": pa.array(out["g"], pa.int64()),
        "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary()),
    })


def _add(rows: pa.Table) -> pa.Table:
    """Totals of the n-grams in a range, for each bucket in the order of its own."""
    keys = [_unpack_keys(x.as_py()) for x in rows["keys"]]
    counts = np.concatenate([_values(x.as_py(), np.uint32) for x in rows["counts"]])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.uint64)
    own, start = [], 0
    for part in keys:
        own.append(_planes(totals[inverse[start : start + len(part)]]))
        start += len(part)
    return pa.table({"g": rows["g"], "k": rows["k"], "r": rows["r"], "totals": pa.array(own, pa.binary())})


def _words(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """The distinct training words of a partition by range, and the number of all (at range 0)."""
    tokens, seen = 0, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        for part in slices(batch.column(0)):
            hashes, _ = word_hashes(*texts_of(batch.column(0).slice(*part)))
            tokens += len(hashes) + part[1]
            seen = np.unique(np.concatenate([seen, hashes, [END]]))
    cuts = np.searchsorted(seen, _range_ends(ranges), side="right").tolist()
    out = [(r, _pack_keys(seen[a:b])) for r, (a, b) in enumerate(zip([0, *cuts], cuts)) if b > a]
    yield pa.RecordBatch.from_pydict({
        "r": pa.array([0, *[r for r, _ in out]], pa.int32()),
        "keys": pa.array([b"", *[k for _, k in out]], pa.binary()),
        "tokens": pa.array([tokens, *[0] * len(out)], pa.int64()),
    })


def _types(rows: pa.Table) -> pa.Table:
    keys = np.concatenate([_unpack_keys(x.as_py()) for x in rows["keys"]])
    return pa.table({"types": pa.array([len(np.unique(keys))]), "tokens": pa.array([sum(rows["tokens"].to_pylist())])})


def vocabulary(texts: DataFrame, ranges: int) -> tuple[int, int]:
    """Number of words, ends included, and of distinct ones in the column ``text``."""
    words = texts.select("text").mapInArrow(lambda b: _words(b, ranges), "r int, keys binary, tokens long")
    counted = words.groupBy("r").applyInArrow(lambda part: _types(part), "types long, tokens long")
    total = counted.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    return total["tokens"] or 0, total["types"] or 0


class Automaton:
    """The part of the model that a bucket's documents can reach."""

    def __init__(self, grams: Grams, totals: dict[int, np.ndarray], tokens: int, types: int, order: int, prior: float):
        self.order, self.grams = order, grams
        self.at, self.arc, self.back, self.seen, self.count = {}, {}, {}, {}, {}
        below = None
        for k in range(1, order + 1):
            counted = grams.counted(k)
            keys, example = np.unique(grams.keys[k][counted], return_index=True)
            example = counted[example]
            count = totals.get(k, np.zeros(0)).astype(np.float64)
            # One entry more stands for START, which is a context but not a word.
            start = count[np.searchsorted(keys, END)] if k == 1 and len(keys) else 0.0
            at = np.full(len(grams.words), len(keys), dtype=np.int64)
            at[counted] = np.searchsorted(keys, grams.keys[k][counted])
            if k == 1:
                chance = (count + ADDED) / (tokens + ADDED * (types + 1))
            else:
                context = self.count[k - 1][self.at[k - 1][example - 1]]
                chance = (count + prior * below[self.at[k - 1][example]]) / (context + prior)
            below = np.append(chance, 1.0)
            self.at[k], self.arc[k] = at, np.log10(below)
            self.count[k] = np.append(count, start)
            self.seen[k] = self.count[k] > 0
            self.back[k] = np.log10(prior / (self.count[k] + prior))

    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the single-word log-probabilities and number of known words, per document."""
        at, first = self.at[1], self.grams.first
        value = self.arc[1][at]
        known = self.seen[1][at].astype(np.int64)
        value[first], known[first] = 0, 0
        return np.add.reduceat(value, first), np.add.reduceat(known, first)

    def walk(self) -> np.ndarray:
        """The log-probability of each document. All documents of the bucket advance together, a
        word a step; each has its state: how many of the last words are its context."""
        grams, longest = self.grams, self.order - 1
        turn = np.argsort(-grams.lengths, kind="stable")
        first, steps = grams.first[turn], grams.lengths[turn] + 1
        total = np.zeros(len(turn))
        state = np.zeros(len(turn), dtype=np.int64)
        if longest:
            state[:] = self.seen[1][self.at[1][first]]
        left = np.searchsorted(-steps, -np.arange(1, steps.max() + 1), side="right")
        for step, n in enumerate(left, 1):
            here = first[:n] + step
            waiting = np.ones(n, dtype=bool)
            reached = np.zeros(n, dtype=np.int64)
            for depth in range(longest, 0, -1):
                gram = self.at[depth + 1][here]
                able = waiting & (state[:n] >= depth)
                takes = able & self.seen[depth + 1][gram]
                fails = able & ~takes
                total[:n] += np.where(takes, self.arc[depth + 1][gram], 0.0)
                total[:n] += np.where(fails, self.back[depth][self.at[depth][here - 1]], 0.0)
                reached[takes] = min(depth + 1, longest)
                waiting &= ~takes
            word = self.at[1][here]
            total[:n] += np.where(waiting, self.arc[1][word], 0.0)
            if longest:
                reached[waiting] = self.seen[1][word[waiting]]
            state[:n] = reached
        out = np.empty(len(turn))
        out[turn] = total
        return out


def _score(rows: pa.Table, model: pa.Table, order: int, prior: float, tokens: int, types: int) -> pa.Table:
    grams = Grams(rows["text"], order)
    model = model.sort_by([("k", "ascending"), ("r", "ascending")])
    totals: dict[int, list] = {}
    for k, data in zip(model["k"].to_pylist(), model["totals"]):
        totals.setdefault(k, []).append(_values(data.as_py(), np.uint64))
    auto = Automaton(grams, {k: np.concatenate(v) for k, v in totals.items()}, tokens, types, order, prior)
    base, known = auto.base()
    return pa.table({
        "doc_id": rows["doc_id"], "held_out": rows["held"], "n_tokens": pa.array(grams.lengths + 1),
        "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(known), tokens)),
        "base_score": pa.array(base), "score": pa.array(auto.walk()),
    })


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", held: str = "held_out",
    order: int = ORDER, prior: float = PRIOR, bucket_bytes: int = BUCKET_BYTES, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (single words) and score (the model), both log10 probabilities of the whole text with its end.

    The model learns from the rows whose ``held`` is false. Words are runs without white space,
    A to Z lower-cased; null texts are empty, and an empty text is its end alone. Nothing to learn
    from: every word has the same unknown chance. Rows with one key are scored each.
    """
    rows = spread(docs.select(
        F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(held, F.lit(False)).alias("held"),
    ))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets, ranges = (max(1, math.ceil(size / part)) for part in (bucket_bytes, range_bytes))
    spot = F.pmod(F.xxhash64(F.lit("bucket"), "doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(buckets))
    rows = rows.withColumn("g", spot)
    tokens, types = vocabulary(rows.where(~F.col("held")), ranges)
    # The same columns as below: the shuffle by bucket is then done once for both.
    counts = rows.groupBy("g").applyInArrow(
        lambda bucket: _count(bucket, order, ranges), f"k int, r int, g long, {_PLANES}"
    )
    model = counts.groupBy("k", "r").applyInArrow(lambda part: _add(part), "g long, k int, r int, totals binary")
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    return rows.groupBy("g").cogroup(model.groupBy("g")).applyInArrow(
        lambda bucket, part: _score(bucket, part, order, prior, tokens, types), schema
    )
