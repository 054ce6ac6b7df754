"""Quality rules: boosted trees over document statistics.

Statistics come from arrays over the bytes of a batch, so no text leaves its task. Trees are fitted
here in numpy, on a bounded sample of labelled rows (``TRAIN_ROWS``): histograms of each statistic,
logistic loss, and for chosen statistics the constraint that the score never rises with them. All
trees lie in flat arrays of nodes, and a batch walks down all of them in step.

Two plain rules come before the trees: too few words, and too many words in repeated runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.wordbytes import chain, slices, word_hashes
from corpusloom.session import spread, written

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
TRAIN_ROWS = 20_000  # about so many labelled rows are fitted on
KEEP = 0.5  # documents whose estimated chance to be good is lower go
TREES, DEPTH, BINS, RATE, LEAST, SMOOTH = 60, 4, 64, 0.2, 5.0, 1.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
# What the trees see, and whether the score may only fall with it (-1) or is free (0).
FEATURES = {
    "symbols": -1, "dup_lines": -1, "repeated": -1, "upper": 0, "digits": 0, "marks": 0, "word_length": 0,
    "distinct": 0, "line_words": 0, "words": 0,
}


def _table(signs: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(signs)] = True
    return out


_SPACE = _table(b" \t\n\v\f\r")
_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(bytes(range(48, 58)))
_MARK = _table(b".,;:!?")
_INNER = np.zeros(256, dtype=bool)
_INNER[0x80:0xC0] = True  # bytes inside a code point
_BLANK = b" \t\n\v\f\r"


# --- statistics -----------------------------------------------------------------------------------


def _per_text(flag: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return np.diff(sums[np.concatenate([[0], ends])])


def repeated_words(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: words that lie in a window of three words that it has twice or more, and
    different words."""
    text = np.repeat(np.arange(len(counts)), counts)
    covered = np.zeros(len(hashes) + 2, dtype=bool)
    if len(hashes) > 2:
        whole = np.flatnonzero(text[2:] == text[:-2])
        key = chain(chain(hashes[whole], hashes[whole + 1]), hashes[whole + 2])
        key = chain(key, text[whole].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key) + 1, dtype=bool)
        same[1:-1] = key[order][1:] == key[order][:-1]
        at = whole[order[same[1:] | same[:-1]]]
        for i in range(3):
            covered[at + i] = True
    _, first = np.unique(chain(hashes, text.astype(np.uint64)), return_index=True)
    return (
        np.bincount(text[covered[: len(text)]], minlength=len(counts)),
        np.bincount(text[first], minlength=len(counts)),
    )


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and MORE of each text of a string column; null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    out = {name: np.zeros(len(column), dtype=np.int64) for name in (*COUNTS, *MORE)}
    for start, count in slices(column):
        part = column.slice(start, count)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + count + 1]
        if offsets[-1] == offsets[0]:
            continue
        data = np.frombuffer(part.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        at = slice(start, start + count)
        hashes, n = word_hashes(data, ends)
        out["n_words"][at] = n
        out["n_repeat_words"][at], out["n_distinct"][at] = repeated_words(hashes, n)
        out["word_chars"][at] = _per_text(~(_SPACE[data] | _INNER[data]), ends)
        for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
            out[name][at] = _per_text(table[data], ends)
        raw = data.tobytes()
        lines = [_lines(raw[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())]
        out["n_lines"][at], out["n_dup_lines"][at] = np.array(lines).T
    return out


def shares(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics as the trees see them, a column for each of FEATURES."""
    words = np.maximum(stats["n_words"], 1)
    chars = np.maximum(stats["word_chars"], 1)
    lines = np.maximum(stats["n_lines"], 1)
    columns = {
        "symbols": stats["n_symbols"] / chars, "dup_lines": stats["n_dup_lines"] / lines,
        "repeated": stats["n_repeat_words"] / words, "upper": stats["n_upper"] / chars,
        "digits": stats["n_digits"] / chars, "marks": stats["n_marks"] / words, "word_length": chars / words,
        "distinct": stats["n_distinct"] / words, "line_words": words / lines, "words": np.log(words),
    }
    return np.stack([columns[f] for f in FEATURES], axis=1)


# --- trees ----------------------------------------------------------------------------------------


@dataclass
class Forest:
    """All trees as arrays of nodes. A row at a node goes to ``child`` if its feature is at most
    ``threshold``, else to the node behind that. A leaf is its own child and has no upper limit."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The estimated chance that a row is good."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = self.child[at] + (x[rows, self.feature[at]] > self.threshold[at])
        return 1.0 / (1.0 + np.exp(-(self.base + self.value[at].sum(1))))


def _best_split(x, rows, grad, hess, cuts, limits, signs):
    """(gain, feature, bin, left weight, right weight) of the best allowed split of a node, or None."""
    low, high = limits
    weight = lambda g, h: np.clip(-g / (h + SMOOTH), low, high)
    loss = lambda g, h, w: -(g * w + 0.5 * (h + SMOOTH) * w * w)
    all_g, all_h = grad[rows].sum(), hess[rows].sum()
    own = loss(all_g, all_h, weight(all_g, all_h))
    best = None
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        g = np.cumsum(np.bincount(x[rows, f], grad[rows], len(edges) + 1))[:-1]
        h = np.cumsum(np.bincount(x[rows, f], hess[rows], len(edges) + 1))[:-1]
        left, right = weight(g, h), weight(all_g - g, all_h - h)
        gain = loss(g, h, left) + loss(all_g - g, all_h - h, right) - own
        gain[(h < LEAST / 4) | (all_h - h < LEAST / 4) | (signs[f] * (right - left) < 0)] = -np.inf
        b = int(gain.argmax())
        if gain[b] > 1e-6 and (best is None or gain[b] > best[0]):
            best = gain[b], f, b, left[b], right[b]
    return best


def fit_trees(x: np.ndarray, good: np.ndarray, signs: tuple[int, ...], trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost trees for the chance that a row is good. ``signs`` has -1 or 1 for a feature with which
    the score may only fall or rise, else 0. A split on such a feature keeps its sides in order,
    and the middle of their weights bounds all that comes below either side."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    mean = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    total = np.full(len(x), base)
    roots, feature, threshold, child, value = [], [], [], [], []

    def add() -> int:
        for column, v in ((feature, 0), (threshold, np.inf), (child, len(child)), (value, 0.0)):
            column.append(v)
        return len(child) - 1

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        grad, hess = p - good, np.maximum(p * (1 - p), 1e-6)
        roots.append(add())
        open_ = [(roots[-1], np.arange(len(x)), (-np.inf, np.inf), 0.0)]
        for _ in range(depth):
            nodes, open_ = open_, []
            for node, rows, limits, own in nodes:
                found = _best_split(binned, rows, grad, hess, cuts, limits, signs)
                if found is None:
                    value[node] = RATE * own
                    total[rows] += value[node]
                    continue
                _, f, b, left, right = found
                middle = (left + right) / 2
                feature[node], threshold[node] = f, cuts[f][b]
                below = binned[rows, f] <= b
                lower, upper = (limits[0], middle), (middle, limits[1])
                sides = {0: (limits, limits), 1: (lower, upper), -1: (upper, lower)}[signs[f]]
                child[node] = len(child)
                for side, keep, w in zip(sides, (below, ~below), (left, right)):
                    open_.append((add(), rows[keep], side, w))
        for node, rows, _, own in open_:
            value[node] = RATE * own
            total[rows] += value[node]
    return Forest(
        base, np.array(roots), np.array(feature), np.array(threshold), np.array(child), np.array(value), depth
    )


# --- over tables ----------------------------------------------------------------------------------


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = statistics(batch.column(batch.num_columns - 1))
        arrays = [*batch.columns[:-1], *map(pa.array, stats.values())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *stats])


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_key and the statistics of each row, written: a few numbers for each text."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, " + ", ".join(f"{c} long" for c in (*COUNTS, *MORE))
    return written(spread(rows).mapInArrow(_measure, schema), "statistics")


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", rows: int = TRAIN_ROWS) -> Forest | None:
    """Trees from measured rows and their labels (1 good, 0 bad; null tells nothing, of several
    the least counts), or None where only one kind or none is labelled. About ``rows`` rows are
    collected, chosen by a hash of key and statistics."""
    known = labels.where(F.col(good).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(good).alias("_good"))
    marked = stats.join(known, "_key")
    total = marked.count()
    if not total:
        return None
    part = F.pmod(F.xxhash64(F.lit("fit"), "_key", *COUNTS), F.lit(1_000_000)) / 1_000_000
    sample = marked.where(part < min(1.0, rows / total)).select("_good", *COUNTS, *MORE).toPandas()
    sample = sample.sort_values(list(sample.columns))  # the same sums whatever the partitions were
    y = (sample["_good"].to_numpy() > 0).astype(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    return fit_trees(shares({c: sample[c].to_numpy() for c in (*COUNTS, *MORE)}), y, tuple(FEATURES.values()))


def _judge(batches: Iterator[pa.RecordBatch], forest: Forest | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = {c: batch.column(c).to_numpy() for c in (*COUNTS, *MORE)}
        chance = np.ones(batch.num_rows)
        for at in range(0, batch.num_rows if forest else 0, 4096):
            chance[at : at + 4096] = forest.score(shares({c: v[at : at + 4096] for c, v in stats.items()}))
        failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEATED * stats["n_words"])
        arrays = [batch.column(0), *[batch.column(c) for c in COUNTS]]
        arrays += [pa.array(failed), pa.array(~failed & (chance >= KEEP)), pa.array(chance)]
        yield pa.RecordBatch.from_arrays(arrays, names=["_key", *COUNTS, "base_failed", "kept", "chance"])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality") -> DataFrame:
    """The key of every row with COUNTS, base_failed, kept, and chance (that it is good, by the trees).

    Null texts are empty and fail. Without labels of both kinds the plain rules decide alone, with
    chance 1. Labels of unknown keys and null keys tell nothing. Rows with one key are judged each;
    an empty table gives no rows; further columns are ignored. One text at a time is in memory
    whole, with some twenty bytes for each of its own.
    """
    stats = measure(docs, key, text)
    forest = fit(stats, labels, key, good)
    kind = stats.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, chance double"
    return stats.mapInArrow(partial(_judge, forest=forest), schema).withColumnRenamed("_key", key)
