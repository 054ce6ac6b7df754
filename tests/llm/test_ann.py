"""Recall, order and odd vectors against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ann
from corpusloom.llm.vector_queries import op10_nearest


def brute(rows, queries, k):
    rows = {i: np.array(v, dtype=float) for i, v in rows.items()}
    out = {}
    for q in queries:
        a = rows[q]
        scored = [
            (-float(a @ b) / (math.sqrt(a @ a) * math.sqrt(b @ b)), i)
            for i, b in rows.items() if i != q and len(b) == len(a)
        ]
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def check(got, want, recall):
    found, total = 0, 0
    for q, best in want.items():
        mine = got.get(q, [])
        assert len(mine) == len(best)
        assert mine == sorted(mine, key=lambda r: (-r[1], r[0]))
        found += len({i for i, _ in mine} & {i for i, _ in best})
        total += len(best)
    assert found >= recall * total


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard_rows", [150, 10_000])
def test_recall_on_random_and_clustered_vectors(spark, shard_rows):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 32))
    rows = {i: (rng.normal(size=32) * 0.7 + centres[i % 5] * (i % 2)).tolist() for i in range(1000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = collected(ann.nearest(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=shard_rows, block_rows=20))
    check(got, brute(rows, range(0, 1000, 20), 5), 0.93)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [3.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1),
        (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1e300, 1e300], 1), (10, [1e-300, 0.0], 1),
        (11, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (1, [2.0, 0.0], 2),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec int")
    got = collected(ann.nearest(df, F.lit(True), k=3))
    assert sorted(got) == [0, 1, 2, 9, 10]
    assert [i for i, _ in got[0]] == [1, 2, 10] and [i for i, _ in got[2]] == [0, 1, 10]
    assert got[9][0][1] == pytest.approx(math.sqrt(0.5))


def test_fewer_candidates_than_k_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert collected(ann.nearest(df, F.col("vec_id") == 0)) == {0: [(1, -1.0)]}
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_query_on_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = collected(op10_nearest(spark, sf_dir))
    want = brute(rows, [i for i in rows if i % 50 == 0], 5)
    check(got, want, 0.9)
    random.seed(0)
    for q, best in want.items():
        scores = dict(best)
        for i, s in got[q]:
            if i in scores:
                assert s == pytest.approx(scores[i], rel=1e-12)
