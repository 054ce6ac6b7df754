"""The term index: equal to scoring every document, and blocks that are left unread."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embedding, postings


def hits(frame, id_col="doc_id"):
    return sorted((r.query_id, r["rank"], r[id_col], round(r.score, 9)) for r in frame.collect())


def questions(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def test_equal_to_scoring_everything(spark, tmp_path):
    """In several adds and small segments, with fewer blocks read than there are."""
    sf_dir, path = "/root/testdata/sf0.01", str(tmp_path / "index")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for i in range(2):
        postings.add(docs.where(F.col("doc_id") % 2 == i), path, segment=16)
    asked = questions(spark, sf_dir)
    found, report = postings.search(spark, path, asked, 5)
    assert hits(found) == hits(embedding.term_search(docs, asked, 5))
    blocks, seen = report.agg(F.sum("blocks"), F.sum("read")).first()
    assert 0 < seen < blocks
    short = asked.withColumn("query_text", F.concat_ws(" ", F.slice(F.split("query_text", " "), 3, 4)))
    found, report = postings.search(spark, path, short, 5)
    assert hits(found) == hits(embedding.term_search(docs, short, 5))
    blocks, seen = report.agg(F.sum("blocks"), F.sum("read")).first()
    assert 0 < seen < 0.7 * blocks


def test_only_the_files_of_the_terms_are_read(spark, sf_dir, tmp_path):
    path = str(tmp_path / "index")
    postings.add(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    rows = postings.read(spark, path, spark.range(1).schema["id"].dataType)
    one = rows.where("term = 'the' AND bucket = 3").select("term", "n")
    assert len(one.inputFiles()) > 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,the)" in plan
    assert "ReadSchema: struct<term:string,n:bigint>" in plan


ODD = [
    ("a", None), ("b", ""), ("c", "Rare word"), ("d", "rare RARE rare"), ("e", "common common"), ("f", "common"),
    ("g", "common"), ("h", "!!"), ("i", "common thing " * 5000), ("j", "Été à la mer"), ("k", "word"),
]


@pytest.mark.parametrize("segment", [1, 2, 100])
def test_odd_texts(spark, tmp_path, segment):
    docs = spark.createDataFrame(ODD, "doc_id string, text string")
    path = str(tmp_path / "index")
    postings.add(docs, path, segment=segment)
    postings.add(docs.limit(0), path, segment=segment)
    asked = spark.createDataFrame(
        [(1, "rare word"), (2, "common"), (3, "nothing known"), (4, ""), (5, None), (6, "été mer été"), (7, "thing common rare")],
        "query_id int, query_text string",
    )
    found, report = postings.search(spark, path, asked, 3, "string")
    assert hits(found) == hits(embedding.term_search(docs, asked, 3))
    assert {r.query_id for r in report.collect()} == {1, 2, 6, 7}


def test_questions_in_blocks(spark, sf_dir, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "index"), questions(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    postings.add(docs, path, segment=20)
    monkeypatch.setattr(postings, "MAX_BROADCAST_QUERIES", 15)
    assert hits(postings.search(spark, path, asked, 4)[0]) == hits(embedding.term_search(docs, asked, 4))


def test_nothing_to_search(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame(ODD, "doc_id string, text string")
    postings.add(docs.where("doc_id = 'a'"), path)
    asked = spark.createDataFrame([(1, "rare")], "query_id int, query_text string")
    found, report = postings.search(spark, path, asked, 3, "string")
    assert found.count() == 0 and report.count() == 0
