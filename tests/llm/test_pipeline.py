"""The pipeline as a whole and its stages one by one."""

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import registry


def test_stages_keep_the_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        assert before >= docs.count() > 0.5 * before, name
        before = docs.count()
    left = {r.doc_id: r.text for r in docs.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(left)
    assert not any("@mail" in t for t in left.values())
    run = registry.queries()["pipeline"](spark, sf_dir)
    key = lambda p: (p.doc_id, p.start, p.ids_crc32)
    assert sorted(map(key, run.collect())) == sorted(map(key, pieces))


def test_odd_documents(spark):
    docs = spark.createDataFrame(
        [(1, None, None, "s", 0), (None, "a text of some words here", "en", "s", 25), (2, "a text of some words here", "en", "s", 25),
         (2, "a text of some words here", "en", "s", 25), (3, "12 34", "en", "s", 5), (4, "write to a@b.org now please", "en", None, None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    sf_dir = "/root/testdata/sf0.001"
    for name in ("score", "_id", "_digest", "_kept", "node", "_text", "spans", "lang_pred"):
        docs = docs.withColumn(name, F.lit(name))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    assert {tuple(r) for r in docs.select(*columns[5:]).collect()} == {tuple(columns[5:])}
    got = sorted((str(r.doc_id), r.text) for r in docs.collect())
    assert got == [("2", "a text of some words here"), ("4", "write to [EMAIL] now please"), ("None", "a text of some words here")]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.limit(0), sf_dir)
    assert docs.count() == 0
