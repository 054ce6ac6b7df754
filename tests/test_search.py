import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.predicates import apply_filter, request_filter
from corpusloom.functions.vectors import distance
from corpusloom.operators import embedding, search
from corpusloom.operators.hits import append_hits, first_provider


def brute(rows, queries, k, metric):
    out = []
    for qid, q in queries:
        scored = []
        for vid, v in rows:
            a, b = np.array(q, float), np.array(v, float)
            if metric == "l2":
                d = ((a - b) ** 2).sum()
            elif metric == "cosine":
                d = 1 - a @ b / np.sqrt((a @ a) * (b @ b))
            else:
                d = 1 - a @ b
            scored.append((round(d, 9) + 0.0, vid))
        out += [(qid, n, vid) for n, (d, vid) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    copy = rows[7][1]
    return rows + [(1000 + i, copy) for i in range(150)]  # a third of all rows is one vector


@pytest.fixture(scope="module")
def frames(spark, vectors):
    rng = np.random.default_rng(4)
    asked = [(i, rng.normal(size=8).tolist()) for i in range(6)] + [(9, vectors[7][1])]
    rows = spark.createDataFrame(vectors, "id bigint, embedding array<float>").repartition(8)
    return rows, spark.createDataFrame(asked, "query_id bigint, query_vector array<double>"), asked


def shown(df):
    return sorted((r.query_id, r["rank"], r.id) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_exact(frames, vectors, metric):
    rows, queries, asked = frames
    want = brute(vectors, asked, 10, metric)
    assert shown(search.nearest(rows, queries, 10, metric)) == want
    assert shown(search.nearest(rows.coalesce(1), queries, 10, metric)) == want


def test_query_blocks_and_two_step_merge(frames, vectors, spark, monkeypatch):
    rows, queries, asked = frames
    want = brute(vectors, asked, 10, "l2")
    monkeypatch.setattr(search, "MAX_BROADCAST_QUERIES", 3)
    assert shown(search.nearest(rows, queries, 10)) == want
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    try:
        assert shown(search.nearest(rows, queries, 10)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_text_ids(frames, vectors):
    rows, queries, asked = frames
    named = rows.withColumn("id", F.format_string("v%05d", "id"))
    want = sorted((q, r, f"v{i:05d}") for q, r, i in brute(vectors, asked, 10, "l2"))
    assert shown(search.nearest(named, queries, 10)) == want


def test_small_batches(frames, vectors, spark):
    rows, queries, asked = frames
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert shown(search.nearest(rows, queries, 10)) == brute(vectors, asked, 10, "l2")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_native_distance_agrees(frames):
    rows, queries, _ = frames
    hits = search.nearest(rows, queries, 3).join(rows, "id").join(queries, "query_id")
    for metric, column in (("l2", "distance"),):
        gap = F.abs(distance(F.col("embedding"), F.col("query_vector"), metric) - F.col(column))
        assert hits.agg(F.max(gap)).first()[0] < 1e-8


def test_k_is_capped_and_scores_follow(frames):
    rows, queries, _ = frames
    hits = search.nearest(rows, queries, 500)
    assert hits.groupBy("query_id").count().agg(F.max("count")).first()[0] == 100
    assert hits.where(F.abs(F.col("score") + F.col("distance") - 1) > 1e-12).count() == 0


def test_filter_reaches_the_scan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = apply_filter(rows, {"$and": [{"label": {"$in": [1, 2]}}, {"vec_id": 3}]})
    plan = part._jdf.queryExecution().toString()
    assert "In(label, [1,2])" in plan and "EqualTo(vec_id,3)" in plan


def test_filter_on_metadata_map(spark):
    df = spark.createDataFrame([(1, {"source": "a"}), (2, {"source": "b"}), (3, {})], "id int, metadata map<string,string>")
    keep = lambda spec: [r.id for r in apply_filter(df, spec).orderBy("id").collect()]
    assert keep({"source": "a"}) == [1]
    assert keep({"source": {"$in": ["a", "b"]}}) == [1, 2]
    assert keep(None) == [1, 2, 3]
    with pytest.raises(ValueError):
        keep({"source": {"$gt": 1}})
    assert request_filter("python", ["x"]) == {"$and": [{"technology": "python"}, {"source": {"$in": ["x"]}}]}
    assert request_filter("cobol") is None


def test_unequal_vectors_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, query_vector array<double>")
    with pytest.raises(Exception, match="unequal length"):
        search.nearest(rows, asked, 1).collect()


def test_no_queries_no_rows(spark, frames):
    rows, queries, _ = frames
    assert search.nearest(rows, queries.limit(0), 3).count() == 0
    assert search.nearest(rows.limit(0), queries, 3).count() == 0


def test_cells(frames, vectors, sf_dir, spark):
    rows, queries, asked = frames
    centres, stored = search.build_cells(rows, 12)
    assert shown(search.nearest_in_cells(stored, centres, queries, 10, 1, exact=True)) == brute(vectors, asked, 10, "l2")
    assert "PartitionFilters: [cell" in search.nearest_in_cells(stored, centres, queries, 10, 1)._jdf.queryExecution().toString()


def test_cells_with_many_queries(frames, vectors, monkeypatch):
    rows, queries, asked = frames
    centres, stored = search.build_cells(rows, 4)
    for options in ({"nprobe": 1}, {"nprobe": 2}, {"nprobe": 1, "exact": True}):
        monkeypatch.setattr(search, "MAX_BROADCAST_QUERIES", 4096)
        want = shown(search.nearest_in_cells(stored, centres, queries, 5, **options))
        for bound in (100, 2):
            monkeypatch.setattr(search, "MAX_BROADCAST_QUERIES", bound)
            assert shown(search.nearest_in_cells(stored, centres, queries, 5, **options)) == want
        if "exact" in options:
            assert want == brute(vectors, asked, 5, "l2")


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_odd_vectors_change_no_other_hit(frames, vectors, spark, metric, monkeypatch):
    rows, queries, asked = frames
    odd = [[float("nan")] * 8, [1.0] * 7 + [float("inf")], None]
    more = spark.createDataFrame([(5000 + i, v) for i, v in enumerate(odd)], rows.schema)
    also = spark.createDataFrame([(5000 + i, v) for i, v in enumerate(odd)], queries.schema)
    rows, queries = rows.unionByName(more).coalesce(1), queries.unionByName(also)
    want = brute(vectors, asked, 10, metric)
    assert shown(search.nearest(rows, queries, 10, metric)) == want
    if metric == "l2":
        centres, stored = search.build_cells(rows, 6)
        assert shown(search.nearest_in_cells(stored, centres, queries, 10, 1, exact=True)) == want
    monkeypatch.setattr(search, "MAX_BROADCAST_QUERIES", 3)
    assert shown(search.nearest(rows, queries, 10, metric)) == want
    assert search.unsearchable(rows).first() == (453, 3)


def test_hits_get_their_content(frames):
    rows, queries, _ = frames
    hits = search.nearest(rows, queries, 3)
    named = rows.withColumn("content", F.concat(F.lit("c"), F.col("id").cast("string"))).select("id", "content")
    want = sorted((r.query_id, r.id, f"c{r.id}") for r in hits.collect())
    got = search.with_content(hits, named).collect()
    assert sorted((r.query_id, r.id, r.content) for r in got) == want


def test_cell_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    queries = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    centres, stored = search.build_cells(rows, 10)
    near = search.nearest_in_cells(stored, centres, queries, 10, 8)
    full = search.nearest(rows, queries, 10)
    both = near.join(full, ["query_id", "id"]).count()
    assert both / full.count() >= 0.95


def test_terms_against_brute_force(spark, monkeypatch):
    import math
    from collections import Counter

    texts = {1: "red fox fox", 2: "red dog", 3: "blue dog dog dog", 4: "", 5: "red red red"} | {i: "red fox" for i in range(20, 30)}
    asked = {1: "fox dog", 2: "red", 3: "nothing here", 4: "Blue FOX"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, query_text string")
    df = Counter(t for text in texts.values() for t in set(text.split()))
    want = []
    for q, question in asked.items():
        qw = {t: (1 + math.log(n)) * math.log(len(texts) / df[t]) for t, n in Counter(question.lower().split()).items() if t in df}
        qn = math.sqrt(sum(w * w for w in qw.values())) or 1
        scored = []
        for d, text in texts.items():
            dw = {t: 1 + math.log(n) for t, n in Counter(text.split()).items()}
            dn = math.sqrt(sum(w * w for w in dw.values())) or 1
            s = round(sum(qw[t] * dw[t] for t in qw if t in dw) / qn / dn, 9)
            if s > 0:
                scored.append((-s, d))
        want += [(q, n, d, -s) for n, (s, d) in enumerate(sorted(scored)[:4], 1)]
    for bound in (4096, 2):
        monkeypatch.setattr(embedding, "MAX_BROADCAST_QUERIES", bound)
        got = embedding.term_search(docs, queries, 4).collect()
        assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in got) == sorted(want)


def test_unknown_provider_comes_last(spark):
    raw = spark.createDataFrame(
        [(1, "newsite", 1), (1, "local_firecrawl", 2), (2, "newsite", 1)], "query_id int, provider string, position int"
    )
    assert sorted((r.query_id, r.provider) for r in first_provider(raw).collect()) == [(1, "local_firecrawl"), (2, "newsite")]


def test_first_provider_and_append(spark):
    raw = spark.createDataFrame(
        [(1, "duckduckgo", 1), (1, "firecrawl", 5), (1, "firecrawl", 4), (2, "fallback", 1), (2, "duckduckgo", 2)],
        "query_id int, provider string, position int",
    )
    first = first_provider(raw, 1)
    assert sorted((r.query_id, r.provider, r.position) for r in first.collect()) == [(1, "firecrawl", 4), (2, "duckduckgo", 2)]
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, rank bigint, id string")
    more = spark.createDataFrame([(1, 1, "c"), (3, 1, "d")], "query_id int, rank bigint, id string")
    out = sorted((r.query_id, r["rank"], r.id) for r in append_hits(hits, more).collect())
    assert out == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (3, 1, "d")]
