"""Quality rules: statistics by plain Python, trees by their laws and held-out labels."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import quality
from corpusloom.llm.quality_queries import op12_quality

ODD = [
    (1, None, 1), (2, "", 1), (3, " \n\t ", 1), (4, "a b a b a b " * 20, 1), (5, "x\ny\nx\n\n \nx \n", 1),
    (6, "a a a", 1), (6, "a a a", 1), (6, "a a a a", 1), (7, "Éa #$|<>&%* ü\x1cz\x00 日本", 1), (None, "no key " * 60, 1),
    (8, " ".join(f"w{i}" for i in range(40_000)), 1), (9, "one\rtwo\vthree\ffour", 1), (10, "w " * 49, 1),
    (11, " ".join(f"w{i}" for i in range(50)), 1),
]
SCHEMA = "doc_id long, text string, kept int"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def test_statistics_of_odd_texts():
    texts = [r[1] for r in ODD] + ["b a b a", "b a", "a b"]
    got = quality.statistics(pa.array(texts).slice(1))
    assert list(zip(*[got[c].tolist() for c in quality.COUNTS])) == [plain(t) for t in texts[1:]]
    assert got["n_distinct"].tolist() == [len(set(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for t in texts[1:]]


def test_statistics_do_not_reach_over_texts():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab  \n#"), rng.integers(0, 40))) for _ in range(400)]
    got = quality.statistics(pa.array(texts))
    assert list(zip(*[got[c].tolist() for c in quality.COUNTS])) == [plain(t) for t in texts]


def test_trees_follow_the_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.2) ^ ((x[:, 0] > 0.8) & (x[:, 1] > 0.5))).astype(float)
    forest = quality.fit_trees(x, y, (-1, 0, 1))
    grid = np.linspace(-0.1, 1.1, 200)
    for row in rng.random((50, 3)):
        for f, sign in ((0, -1), (2, 1)):
            line = np.tile(row, (200, 1))
            line[:, f] = grid
            assert (sign * np.diff(forest.score(line)) >= -1e-12).all()
    free = quality.fit_trees(x, y, (0, 0, 0))
    assert ((free.score(x) > 0.5) == y).mean() > ((forest.score(x) > 0.5) == y).mean() > 0.7

    def walk(row, node):  # one row through one tree
        while forest.child[node] != node:
            node = forest.child[node] + (row[forest.feature[node]] > forest.threshold[node])
        return forest.value[node]

    want = [forest.base + sum(walk(r, root) for root in forest.roots) for r in x[:50]]
    assert forest.score(x[:50]) == pytest.approx(1 / (1 + np.exp(-np.array(want))))


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(1, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    for labels in (none, some):
        rows = quality.judge(docs, labels).collect()
        assert sorted(map(str, ((r.doc_id, *[r[c] for c in quality.COUNTS]) for r in rows))) == sorted(
            str((k, *plain(t))) for k, t, _ in ODD
        )
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept is not r.base_failed and r.chance == 1
    assert quality.judge(docs.limit(0), some).count() == 0


def test_held_out_quality(spark):
    """Trees that learn from some labels find what the others say."""
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = labels.where("doc_id % 3 <> 0")
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    rows = [r for r in quality.judge(docs, seen).collect() if r.doc_id in held]
    good = [r.chance >= quality.KEEP for r in rows if held[r.doc_id] == 1]
    bad = [r.chance >= quality.KEEP for r in rows if held[r.doc_id] == 0]
    assert len(good) > 800 and sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_the_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op12_quality(spark, sf_dir).collect()
    assert {r.doc_id: tuple(r[c] for c in quality.COUNTS) for r in rows} == {k: plain(t) for k, t in texts.items()}
    assert all(r.kept == (not r.base_failed and r.chance >= quality.KEEP) for r in rows)
    again = op12_quality(spark, sf_dir).collect()
    assert {(r.doc_id, r.chance) for r in rows} == {(r.doc_id, r.chance) for r in again}
