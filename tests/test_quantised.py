"""Search by codes: recall against measuring every row, exact scores, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import quantised, search


def table(spark, sf="sf0.1"):
    return spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")


def test_recall_and_scores(spark):
    rows = table(spark)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    book = quantised.fit(rows, 32)
    index = quantised.build(rows, book)
    assert index.count() == rows.count()
    assert {len(r.code) for r in index.select("code").collect()} == {16}
    found = {(r.query_id, r.id): r.distance for r in quantised.search(index, book, asked, 10).collect()}
    exact = {(r.query_id, r.id): r.distance for r in search.nearest(rows, asked, 10).collect()}
    same = found.keys() & exact.keys()
    assert len(found) == len(exact) == 1000
    assert len(same) >= 0.9 * len(exact)
    assert all(abs(found[p] - exact[p]) < 2e-9 for p in same)
    # The codes do the work: with few candidates most of the nearest are among them.
    few = {(r.query_id, r.id) for r in quantised.search(index, book, asked, 10, candidates=2).collect()}
    assert len(few & exact.keys()) >= 0.6 * len(exact)
    near = quantised.search(index, book, asked, 10, nprobe=16).collect()
    assert 0.7 * len(exact) <= len({(r.query_id, r.id) for r in near} & exact.keys()) < len(exact)
    every = quantised.search(index, book, asked, 10, candidates=10_000).collect()
    assert {(r.query_id, r.id): r.distance for r in every} == pytest.approx(exact, abs=2e-9)


def test_blocks_of_questions(spark, monkeypatch):
    rows = table(spark, "sf0.001")
    asked = rows.limit(40).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    book = quantised.fit(rows, 4, parts=7, entries=16)  # parts that do not divide the width
    index = quantised.build(rows, book)
    whole = sorted(map(str, quantised.search(index, book, asked, 5).collect()))
    monkeypatch.setattr(search, "MAX_BROADCAST_QUERIES", 7)
    assert sorted(map(str, quantised.search(index, book, asked, 5).collect())) == whole


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [("a", [1.0, 0.0, 2.0]), ("b", [1.0, 0.0, 2.0]), ("c", None), ("d", [nan, 0.0, 0.0]), ("e", [None, 1.0, 1.0]), ("f", [5.0, 5.0, 5.0])]
    frame = spark.createDataFrame(rows, "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, None), (3, [nan, 0.0, 0.0])], "query_id int, query_vector array<double>")
    book = quantised.fit(frame, 10)
    index = quantised.build(frame, book)
    hits = quantised.search(index, book, asked, 2).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.distance) for r in hits] == [(1, "a", 0.0), (1, "b", 0.0)]
    with pytest.raises(ValueError):
        quantised.fit(frame.limit(0), 3)
    assert quantised.search(index.limit(0), book, asked, 2).count() == 0
    assert quantised.search(index, book, asked.limit(0), 2).count() == 0


def test_tables_equal_the_distances():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 10))
    book = quantised.Book(vectors[:3], rng.normal(size=(4, 8, 3)))
    cell, code = book.encode(vectors)
    rebuilt = book.middles[cell] + np.concatenate([book.entries[j, code[:, j]] for j in range(4)], 1)[:, :10]
    padding = np.concatenate([book.entries[j, code[:, j]] for j in range(4)], 1)[:, 10:]
    for c in range(3):
        mine = cell == c
        tables = book.tables(vectors[:5], c)
        got = sum(tables[:, j][:, code[mine, j]] for j in range(4))
        want = ((vectors[:5, None] - rebuilt[mine][None]) ** 2).sum(2) + (padding[mine] ** 2).sum(1)[None]
        assert got == pytest.approx(want)
