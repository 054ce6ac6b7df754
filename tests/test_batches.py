"""What a task holds is bounded, whatever comes in one batch."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions.batches import cut


def _texts(rows: int, words: int) -> pa.RecordBatch:
    texts = [" ".join(f"w{(i * words + j) % 997}" for j in range(words)) for i in range(rows)]
    return pa.RecordBatch.from_pydict({"id": list(range(rows)), "text": texts})


def test_cut_keeps_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "text": ["aaa", None, "a" * 50, "", "a" * 9, "a"]})
    parts = list(cut(iter([batch, batch.slice(0, 0)]), 1, 10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(6))
    assert [p.num_rows for p in parts] == [2, 2, 2]


def test_index_segments_of_one_large_batch(spark, monkeypatch):
    """one batch of many texts is inverted in parts."""
    from corpusloom.operators import postings

    class Task:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(postings.TaskContext, "get", staticmethod(lambda: Task))
    monkeypatch.setattr(postings, "HELD_BYTES", 3 << 20)
    batch = _texts(3000, 500)
    made = list(postings._invert(iter([batch]), 64))
    assert len(made) >= 2 and max(m.nbytes for m in made) < 60 << 20
    whole = pa.Table.from_batches(made)
    documents = whole.filter(pa.compute.equal(whole["term"], ""))["ids"].combine_chunks().flatten()
    assert sorted(documents.to_pylist()) == list(range(3000))
    assert len(set(zip(whole["segment"].to_pylist(), whole["term"].to_pylist()))) == whole.num_rows


def test_large_files_grow_in_number(spark, sf_dir, monkeypatch):
    """F6, F7, F8: more splits of the table make more files, not longer ones."""
    from corpusloom.plans import file_queries, tables

    monkeypatch.setattr(file_queries, "documents", lambda *a: tables.documents(*a).repartition(12))
    for make in (file_queries._large_arrays, file_queries._large_table):
        files = spark.read.text(make(spark, sf_dir)).select(F.input_file_name()).distinct().count()
        assert files == 6


def test_tables_of_codes_for_few_questions_at_a_time(spark, monkeypatch):
    """tables are made for groups of questions, and the hits are those of one group."""
    from corpusloom.operators import quantised

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(120)], "id long, embedding array<double>")
    asked = rows.where("id < 30").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    book = quantised.fit(rows, 3, 4, 16)
    indexed = quantised.build(rows, book)
    held = [tuple(r) for r in asked.collect()]
    probes = np.ones((len(held), 3), dtype=bool)
    schema = "query_id long, id long, _near double"
    found = []
    for most in (256, 7):
        monkeypatch.setattr(quantised, "_TABLES", most)
        part = quantised._candidates(indexed.coalesce(1), held, book, probes, 5, "id", schema)
        found.append(sorted((r[0], r[1], round(r[2], 9)) for r in part.collect()))
    assert found[0] == found[1] and len(found[0]) >= 150
