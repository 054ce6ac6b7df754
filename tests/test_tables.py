"""Caches, upsert, and the joins and cuts under them, with a hot key or moment in each."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import response_key
from corpusloom.operators import caches, embedding, joins, store

START = "timestamp'2024-01-01 00:00:00'"


def digest(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def cache_of(spark, entries):
    rows = [(digest(i), f"response {i}", t) for i, t in entries]
    df = spark.createDataFrame(rows, "key string, response string, t bigint")
    at = F.timestamp_micros(F.col("t"))
    return df.select("key", "response", at.alias("created_at"), at.alias("accessed_at"))


def keys(df):
    return sorted(r.key for r in df.select("key").collect())


def test_split_matches_sort(spark, monkeypatch):
    """Also when a third of all entries share one moment, with tiny sorting bounds."""
    monkeypatch.setattr(joins, "CUT_ROWS", 5)
    monkeypatch.setattr(joins, "_CUT_BUCKETS", 20)
    rng = random.Random(5)
    entries = [(i, 77 if i % 3 == 0 else rng.randrange(10**7)) for i in range(300)]
    cache = cache_of(spark, entries).coalesce(2)
    order = [digest(i) for i, t in sorted(entries, key=lambda e: (e[1], digest(e[0])))]
    for n in (1, 50, 120, 300):
        first, rest = joins.split_at(cache, n, "accessed_at", "key")
        assert keys(first) == sorted(order[:n]) and keys(rest) == sorted(order[n:])


def test_lru_and_bulk_eviction(spark):
    cache = cache_of(spark, [(i, i) for i in range(11)])
    assert keys(caches.keep_recent(cache, 10)) == sorted(digest(i) for i in range(1, 11))
    assert keys(caches.keep_recent(cache, 11)) == keys(cache)
    assert keys(caches.evict_oldest(cache, 12)) == keys(cache)
    assert keys(caches.evict_oldest(cache, 11)) == sorted(digest(i) for i in range(1, 11))
    big = cache_of(spark, [(i, i) for i in range(45)])
    assert keys(caches.evict_oldest(big, 40)) == sorted(digest(i) for i in range(4, 45))


def test_store_evicts_only_for_new_keys(spark):
    cache = cache_of(spark, [(i, i) for i in range(10)])
    again = cache_of(spark, [(3, 99)]).withColumn("response", F.lit("changed"))
    kept = caches.store(cache, again, 10)
    assert kept.count() == 10 and kept.where("response = 'changed'").count() == 1
    grown = caches.store(cache, cache_of(spark, [(50, 99)]), 10)
    assert keys(grown) == sorted(digest(i) for i in [*range(1, 10), 50])


def test_store_keeps_the_limit(spark):
    """As many new keys as you like: the result is that of adding them one by one."""
    for size, added, limit, drop in [(10, 1, 10, 1), (10, 50, 10, 1), (0, 11, 10, 1), (20, 7, 20, None), (35, 13, 40, 4), (44, 30, 40, 4)]:
        entries = [(i, i) for i in range(size)]
        new = [(100 + i, 1000 + i) for i in range(added)]
        held = [k for k, _ in entries][-limit:]
        for k, _ in new:
            if len(held) >= limit:
                held = held[max(1, limit // 10 if drop is None else drop):]
            held.append(k)
        got = caches.store(cache_of(spark, entries), cache_of(spark, new), limit, drop)
        assert keys(got) == sorted(map(digest, held)), (size, added, limit, drop)


def test_entries_without_a_time_are_oldest(spark):
    timed = cache_of(spark, [(i, i) for i in range(20)])
    cache = timed.withColumn("accessed_at", F.when(~F.col("key").isin([digest(i) for i in (5, 6, 7, 8)]), F.col("accessed_at")))
    assert keys(caches.keep_recent(cache, 18)) == sorted(set(map(digest, range(20))) - set(sorted(map(digest, (5, 6, 7, 8)))[:2]))
    assert caches.keep_recent(cache, 3).count() == 3


def test_lookups_refresh_entries(spark):
    cache = cache_of(spark, [(i, i) for i in range(4)])
    asked = cache_of(spark, [(0, 50), (0, 60), (9, 70)]).select("key", F.col("accessed_at").alias("at"))
    touched = caches.touch(cache, asked)
    assert touched.columns == cache.columns
    assert keys(caches.keep_recent(touched, 1)) == [digest(0)]


def test_scratch_only_in_a_shared_folder(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from corpusloom import session

    named = spark.conf.get(session.CHECKPOINT_KEY, None)
    away = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: None),
        sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None),
    )
    with pytest.raises(RuntimeError, match="share"):
        session.shared_dir(away)
    kept = session.written(spark.range(3), "mine")
    assert kept.count() == 3 and session.own_scratch(spark) in kept.inputFiles()[0]
    assert named is None or session.own_scratch(spark).startswith(named)


def test_numbering_and_ties_with_nulls(spark):
    rows = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, t int")
    assert sorted((str(r.g), r.t, r.n) for r in joins.numbered(rows, "g", "t", "n").collect()) == [("None", 1, 1), ("None", 2, 2), ("a", 5, 1)]
    same = spark.createDataFrame([(1, 0, x) for x in "abcdefgh"], "id int, seq int, v string")
    assert len({joins.latest_per_key(same.repartition(n), "id", "seq").first().v for n in (1, 3, 8)}) == 1
    assert joins.latest_per_key(same, "id", "seq", "v").first().v == "h"


def test_lookup_hot_key(spark, monkeypatch):
    """A third of the rows ask for one key: they are joined apart, with the same result."""
    rows = spark.range(600).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(digest(0))).when(F.col("id") == 1, F.lit(None)).otherwise(
            F.sha2(F.col("id").cast("string"), 256)).alias("key")
    )
    cache = cache_of(spark, [(i, i) for i in range(300)])
    plain = sorted(map(str, caches.lookup(rows, cache, "response").collect()))
    monkeypatch.setattr(joins, "HOT_SAMPLE", 1.0)
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    assert joins.hot_keys(rows, "key") == [digest(0)]
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        split = sorted(map(str, caches.lookup(rows, cache, "response").collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    assert split == plain and len(plain) == 600


def test_cache_round_trip_and_case(spark, tmp_path):
    """Stored answers are found again whatever the case of the question."""
    pairs = spark.createDataFrame([("Test Query", "This is a test response"), ("other", "short")], "q string, response string")
    context = F.array(F.lit("test content"))
    cache = pairs.where("length(response) >= 10").select(
        response_key("q", context).alias("key"), "response",
        F.expr(START).alias("created_at"), F.expr(START).alias("accessed_at"),
    )
    caches.save(cache, str(tmp_path / "c"))
    loaded = caches.load(spark, str(tmp_path / "c"), cache.schema)
    asked = spark.createDataFrame([("test query",), ("TEST QUERY ",), ("other",)], "q string").withColumn("key", response_key("q", context))
    found = {r.q: r.response for r in caches.lookup(asked, loaded, "response").collect()}
    assert found == {"test query": "This is a test response", "TEST QUERY ": "This is a test response", "other": None}
    rate = caches.hit_rate(caches.lookup(asked, loaded, "response")).first()
    assert (rate.lookups, rate.hits) == (3, 2)
    late = caches.lookup(asked, loaded, "response", ttl_seconds=3600, now="2024-01-01 02:00:00")
    assert late.where("hit").count() == 0
    assert caches.clear(loaded, str(tmp_path / "c")).count() == 0
    assert caches.load(spark, str(tmp_path / "c"), cache.schema).count() == 0


def test_empty_cache_stats(spark):
    row = caches.cache_stats(cache_of(spark, []), 10).first()
    assert (row.total_entries, row.max_size, row.oldest_entry) == (0, 10, None)


def test_numbering_in_blocks(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 10 + 2).cast("int").alias("g"), (F.col("id") * 7).alias("o")
    )
    got = {(r.g, r.o): r.n for r in joins.numbered(rows, "g", "o", "n", block=50).collect()}
    groups = {}
    for g, o in got:
        groups.setdefault(g, []).append(o)
    assert got == {(g, o): n for g, os in groups.items() for n, o in enumerate(sorted(os), 1)}


def test_upsert(spark, monkeypatch):
    old = spark.createDataFrame([("a", "d1", 1), ("b", "d1", 2), ("c", "d2", 3)], "id string, doc string, v int")
    new = spark.createDataFrame([("a", "d1", 10, 1), ("a", "d1", 11, 2), ("z", "d9", 12, 1)], "id string, doc string, v int, seq int")
    once = store.upsert(old, new)
    values = lambda df: {r.id: r.v for r in df.collect()}
    assert values(once) == {"a": 11, "b": 2, "c": 3, "z": 12}
    assert values(store.upsert(once, new)) == values(once)
    assert values(store.upsert(old, new, document_col="doc")) == {"a": 11, "c": 3, "z": 12}
    monkeypatch.setattr(joins, "SMALL_ROWS", 0)
    assert values(store.upsert(old, new, document_col="doc")) == {"a": 11, "c": 3, "z": 12}
    assert store.rows_written(new).first().asDict() == {"offered": 3, "written": 2}


def test_cleaning_on_the_way_in(spark):
    rows = spark.createDataFrame([("a\x00b", {"k": None})], "content string, metadata map<string,string>")
    row = store.cleaned(rows).first()
    assert (row.content, row.metadata) == ("ab", {"k": ""})


def test_embedding_cache_order_and_misses(spark):
    """Texts that are known are not embedded again; equal texts share one vector."""
    texts = ["alpha", "beta text", "ALPHA ", "new text", "new text", "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen = spark.sparkContext.accumulator(0)

    def embed(batch):
        seen.add(len(batch))
        return [[float(len(t)), 1.0] for t in batch]

    from corpusloom.functions.text import embedding_key

    known = docs.where("doc_id < 2").select(embedding_key("text").alias("key"), F.array(F.lit(0.5).cast("float")).alias("embedding"))
    rows, new = embedding.embed_with_cache(docs, known, embedding.model_hook(embed))
    got = {r.doc_id: list(r.embedding) for r in rows.collect()}
    assert got == {0: [0.5], 1: [0.5], 2: [0.5], 3: [8.0, 1.0], 4: [8.0, 1.0], 5: [3.0, 1.0]}
    assert sorted(r.text_length for r in new.collect()) == [8]
    assert rows.count() == 6 and seen.value == 2  # once, however often the results are used


def test_null_texts_are_vectors_of_zeros(spark):
    docs = spark.createDataFrame([(1, None), (2, "red fox"), (3, "red dog")], "doc_id int, text string")
    model = embedding.fit_vectoriser(docs)
    got = {r.doc_id: r.embedding for r in embedding.vectorise(docs, model).collect()}
    assert not any(got[1]) and sum(x * x for x in got[2]) == pytest.approx(1, abs=1e-6)
    assert got[2] != got[3]


def test_transcript_with_sources(spark):
    from corpusloom.operators.prompts import shown_sources, transcripts

    rows = [(1, 0, "user", "q", None), (1, 1, "assistant", "a", ["T1", None]), (1, 1000, "user", "later", None)]
    talk = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, sources array<string>")
    got = {r.page: (r.messages, r.transcript) for r in transcripts(talk, sources="sources").collect()}
    assert got == {0: (2, "user: q\nassistant: a\n- T1\n- Unknown"), 1: (1, "user: later")}
    hits = spark.createDataFrame([(1, 1, "T", "django"), (1, 2, None, None), (1, 6, "x", "y")], "query_id int, rank int, title string, technology string")
    assert [r.line for r in shown_sources(hits).orderBy("rank").collect()] == ["- **T** (django)", "- **Untitled** (General)"]
