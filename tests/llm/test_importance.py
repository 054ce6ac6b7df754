"""Importance resampling: checksums, features and draws against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import importance

ODD = [
    (1, None, "a"), (2, "", "b"), (3, "One two, TWO three-four éé ÉÀ 日本 x9 " * 4, "c"), (4, "w" * 5000 + " " + "z" * 129, "d"),
    (5, " \n\t!?", "e"), (6, "alpha beta " * 15, "f"), (6, "alpha beta " * 15, "f"), (6, "gamma " * 30, "g"),
    (None, "no key " * 12, "h"), (7, "alpha beta " * 15, "i"), (8, "\x00 null\x7fsign {brace} `tick`", "j"),
]
SCHEMA = "doc_id long, text string, rank string"


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def runs(text, most):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def bucket(feature, buckets=10000):
    return zlib.crc32(feature.encode()) % buckets


def expected(docs, target, most=1, percent=10):
    s, t = (Counter(bucket(f) for text in side for f in runs(text, most)) for side in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for key, text, *_ in docs:
        found = runs(text, most)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(words_of(text)), len(found), weight, score, None])
    long = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for i, r in enumerate(long[: percent * len(long) // 100]):
        r[5] = i + 1
    return sorted(map(str, rows))


def plain(frame):
    names = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    return sorted(str([r[n] for n in names]) for r in frame.collect())


def test_checksums_of_spans():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 100_000).astype(np.uint8)
    starts = np.concatenate([rng.integers(0, 99_000, 2000), [0, 5, 7, 9, 0]])
    ends = np.concatenate([starts[:2000] + rng.integers(1, 200, 2000), [100_000, 69, 70, 74, 65_536]])
    got = importance.checksums(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert len(importance.checksums(data, starts[:0], ends[:0])) == 0


@pytest.mark.parametrize("words", [1, 2, 3])
def test_features_of_odd_texts(words, monkeypatch):
    column = pa.array([d[1] for d in ODD])
    for piece in (importance.PIECE, 50):  # long texts in pieces
        monkeypatch.setattr(importance, "PIECE", piece)
        got = [Counter() for _ in ODD]
        total = np.zeros(len(ODD), dtype=int)
        for i in range(len(ODD)):  # alone, so that they may be cut, and sliced
            for start, totals, rows, found in importance.features(column.slice(i, 1), words, 10000):
                assert start == 0 and set(rows) <= {0}
                got[i].update(found.tolist())
                total[i] += totals.sum()
        assert got == [Counter(map(bucket, runs(d[1], words))) for d in ODD]
        assert total.tolist() == [len(words_of(d[1])) for d in ODD]
    together = [Counter() for _ in ODD]
    for start, _, rows, found in importance.features(column, words, 10000):
        for r, b in zip(rows.tolist(), found.tolist()):
            together[start + r][b] += 1
    assert together == got


@pytest.mark.parametrize("words", [1, 2])
def test_resampling_odd_rows(spark, words):
    docs = spark.createDataFrame(ODD, SCHEMA)
    target = spark.createDataFrame([("alpha alpha beta",), (None,), ("ÉÀ two",)], "text string")
    got = importance.resample(docs, target, words=words, percent=40)
    assert plain(got) == expected(ODD, ["alpha alpha beta", None, "ÉÀ two"], words, 40)
    none = importance.resample(docs, target.limit(0), words=words, percent=40)
    assert plain(none) == expected(ODD, [], words, 40)
    assert importance.resample(docs.limit(0), target).count() == 0


def test_ranks_over_many_ranges(spark, monkeypatch):
    docs = [(i, "alpha beta " * (10 + i % 3), "") for i in range(300)] + [(i, "few words", "") for i in range(300, 320)]
    monkeypatch.setattr(importance, "RANKED_ROWS", 40)
    target = spark.createDataFrame([("alpha",)], "text string")
    got = importance.resample(spark.createDataFrame(docs, SCHEMA), target, percent=35)
    assert plain(got) == expected(docs, ["alpha"], 1, 35)


def test_sample_keeps_whole_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    target = spark.createDataFrame([("alpha beta",)], "text string")
    drawn = {r.doc_id for r in importance.resample(docs, target, percent=50).collect() if r.rank}
    kept = importance.sample(docs, target, percent=50)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == drawn - {None}
