"""What the plans look like: pruned scans, no needless shuffles, no products."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.operators import chunking, hits, search, stats, store
from corpusloom.session import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_products_anywhere(spark, sf_dir):
    for name, query in entry.queries().items():
        text = plan(query(spark, sf_dir))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_search_reads_two_columns_and_limits_early(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("extra", F.col("label") * 2)
    asked = search.label_means(rows).withColumnRenamed("label", "query_id")
    text = plan(search.nearest(rows, asked, 5, where={"label": 3}, id_col="vec_id"))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in text
    assert "EqualTo(label,3)" in text
    assert text.count("Exchange") == 1 and "WindowGroupLimit" in text


def test_chunking_does_not_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    for made in (
        chunking.chunk_documents(docs), chunking.fixed_windows(docs),
        chunking.header_sections(docs), chunking.fence_segments(docs),
    ):
        text = plan(made)
        assert "Exchange" not in text and "Window " not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(chunking.chunk_documents(docs))


def test_spread_only_when_needed(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert spread(docs, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    docs.repartition(16).write.parquet(str(tmp_path / "many"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        many = spark.read.parquet(str(tmp_path / "many"))
        assert many.rdd.getNumPartitions() >= 8
        assert spread(many, "doc_id") is many
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_groups_are_limited_before_the_shuffle(spark):
    raw = spark.range(100).select(
        (F.col("id") % 2).alias("query_id"), F.concat(F.lit("p"), F.col("id") % 3).alias("provider"),
        F.col("id").alias("position"),
    )
    text = plan(hits.first_provider(raw, 3))
    assert text.count("WindowGroupLimit") == 2
    text = plan(store.latest_per_key(raw.withColumnRenamed("position", "seq"), "query_id", "seq"))
    assert text.count("WindowGroupLimit") == 2


def test_statistics_take_one_pass(spark):
    events = spark.range(10).select(F.lit("a").alias("endpoint"), F.col("id").cast("double").alias("seconds"))
    text = plan(stats.latency_histogram(events, ["endpoint"], "seconds"))
    assert text.count("Exchange") == 1 and "Expand" not in text


def test_upsert_broadcasts_a_small_batch(spark):
    old = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("content"))
    new = old.limit(3).withColumn("seq", F.lit(1))
    text = plan(store.upsert(old, new))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_texts_are_embedded_once(spark, sf_dir):
    """Whether a vector can be searched is tested behind the function that makes it."""
    from corpusloom.operators import embedding
    from corpusloom.plans import flows

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = embedding.fit_vectoriser(docs)
    asked = docs.limit(5).select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 200).alias("question"))
    vectors = embedding.vectorise(docs, model).select("doc_id", "embedding")
    text = plan(flows.search_texts(vectors, asked, model, id_col="doc_id"))
    assert text.count("ArrowEvalPython") == 1 and text.count("MapInArrow") == 1
