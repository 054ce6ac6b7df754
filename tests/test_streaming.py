"""Streams in several batches against the batch result, with repeats and late rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking
from corpusloom.plans import flows
from corpusloom.operators import embedding
from corpusloom.sources import files
from corpusloom.streaming import ingest, monitor, sink


def test_ingest_in_batches(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content")
    )
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.ingest_documents(
        spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")),
        str(tmp_path / "out"), str(tmp_path / "state"),
    ).awaitTermination()
    run()
    batch = ingest.document_chunks(docs)
    stored = lambda: sink.read_latest(spark, str(tmp_path / "out"), batch.schema, ["id"])
    want = sorted(map(str, batch.select("id", "content").collect()))
    assert sorted(map(str, stored().select("id", "content").collect())) == want
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == 4
    # a changed document replaces its chunks; nothing else moves
    changed = docs.where("title = 'd0'").withColumn("content", F.lit("short now"))
    changed.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert stored().where("id = 'upload_d0_0'").first().content == "short now"
    sink.compact(spark, str(tmp_path / "out"), batch.schema, ["id"], str(tmp_path / "compact"))
    again = sink.read_latest(spark, str(tmp_path / "compact"), batch.schema, ["id"])
    assert sorted(map(str, again.collect())) == sorted(map(str, stored().collect()))


def test_counts_over_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", F.col("event_type").alias("endpoint"))
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = monitor.windowed_counts(monitor.timed(stream, late=None), ["endpoint"])
    sink.write_batches(counts, str(tmp_path / "out"), str(tmp_path / "state"), "update").awaitTermination()
    got = sink.read_latest(spark, str(tmp_path / "out"), counts.schema, ["window_start", "endpoint"])
    want = monitor.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), ["endpoint"])
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["stream_hourly_counts", "stream_latency", "stream_rate_breaches", "stream_ingest"])
def test_registered_streams_over_many_files(spark, sf_dir, tmp_path, name):
    """Tables of six files in no order of time give what one file gives."""
    from corpusloom.plans import stream_queries

    for table in ("events", "documents"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(6).write.parquet(str(tmp_path / f"{table}.parquet"))
    query = stream_queries.QUERIES[name]
    got, want = (sorted(map(str, query(spark, d).collect())) for d in (str(tmp_path), sf_dir))
    assert got == want


def test_a_shorter_version_replaces_all_chunks(spark, tmp_path):
    schema = "title string, content string"
    for text in ("one two three. " * 400, "short now"):
        spark.createDataFrame([("d", text), ("e" + text[:1], "other")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.ingest_documents(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    chunks = ingest.document_chunks(spark.createDataFrame([], schema))
    rows = sink.read_documents(spark, str(tmp_path / "out"), chunks.schema, "title").collect()
    assert sorted((r.title, r.chunk_position, r.content) for r in rows) == [("d", 0, "short now"), ("eo", 0, "other"), ("es", 0, "other")]


def test_late_rows_are_left_out(spark, tmp_path):
    schema = "ts timestamp_ntz, endpoint string"
    batches = [("2024-01-01 00:10:00", "2024-01-01 05:00:00"), ("2024-01-01 06:00:00",), ("2024-01-01 00:20:00",)]
    path = tmp_path / "in"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for times in batches:
        rows = spark.createDataFrame([(t,) for t in times], "t string")
        rows.select(F.col("t").cast("timestamp_ntz").alias("ts"), F.lit("e").alias("endpoint")).coalesce(1).write.mode("append").parquet(str(path))
        stream = spark.readStream.schema(schema).parquet(str(path))
        counts = monitor.windowed_counts(monitor.timed(stream, late="1 hour"), ["endpoint"])
        sink.write_batches(counts, out, state, "update").awaitTermination()
    got = sink.read_latest(spark, out, counts.schema, ["window_start", "endpoint"]).collect()
    assert sorted((r.window_start.hour, r.total) for r in got) == [(0, 1), (5, 1), (6, 1)]


def test_breaches(spark, tmp_path):
    rows = [("2024-01-01 00:00:%02d" % s, "c1", "upload") for s in range(11)] + [("2024-01-01 00:01:00", "c1", "upload"), ("2024-01-01 00:00:01", "c2", "upload")]
    events = spark.createDataFrame(rows, "t string, client string, endpoint string").select(F.col("t").cast("timestamp").alias("ts"), "client", "endpoint")
    got = monitor.breaches(events, "client", "endpoint", {"upload": 10}).collect()
    assert [(r.client, r.calls, r.allowed) for r in got] == [("c1", 11, 10)]


@pytest.fixture(scope="module")
def uploads(tmp_path_factory):
    root = tmp_path_factory.mktemp("up")
    (root / "guide.md").write_text("Use asyncio for network code.\n\n```python\nimport asyncio\n```\nThen await it.")
    (root / "notes.txt").write_text("Gardening notes about roses and tulips in spring.")
    (root / "skip.exe").write_bytes(b"MZ\x00")
    return root


def test_files_as_a_stream(spark, uploads, tmp_path):
    stream = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).option("maxFilesPerTrigger", 1).load(str(uploads))
    ingest.ingest_files(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert {r.id for r in rows.collect()} == {"upload_guide.md_0", "upload_guide.md_1", "upload_guide.md_2", "upload_notes.txt_0"}
    assert {r.source for r in rows.collect()} == {"api_upload"}


def test_upload_then_ask(spark, uploads):
    docs = files.extract(files.read_files(spark, str(uploads))).where("success")
    model = embedding.fit_vectoriser(docs, "content")
    model = embedding.fit_vectoriser(docs.withColumnRenamed("content", "text"))
    chunks = chunking.chunk_documents(docs.select(F.col("filename").alias("title"), "content"))
    empty = chunks.limit(0).select(F.lit("").alias("id"), "title", "content")
    collection, report = flows.ingest(files.read_files(spark, str(uploads)), empty, model)
    assert collection.count() == 4 and report.where("success").count() == 2
    asked = spark.createDataFrame([(1, "tulips and roses"), (2, "  ")], "query_id bigint, question string")
    made, found = flows.ask(collection, asked, model, "openai", k=1)
    best = found.where("rank = 1").collect()
    assert [(r.query_id, r.title) for r in best] == [(1, "notes.txt")]
    prompts = {r.query_id: r for r in made.collect()}
    assert "1. From 'notes.txt':\nGardening notes" in prompts[1].prompt
    assert prompts[1].prompt.endswith("Question: Question: tulips and roses")
    assert [m.role for m in prompts[1].messages] == ["system", "user"]
    assert prompts[2].prompt.startswith("\n\nQuestion:")
    code, _ = flows.ask(collection, asked, model, mode="code_generation")
    assert "Generate python code for the following request" in code.first().prompt


def test_corpus_from_files(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps([{"title": "t", "content": "alpha beta", "source": "s"}]))
    out = flows.chunk_corpus([str(tmp_path / "a.json")], spark, str(tmp_path / "saved"))
    assert [(r.title, r.content, r.total_chunks) for r in out.collect()] == [("t", "alpha beta", 1)]


def _calls(spark, rows):
    schema = "t string, client string, endpoint string"
    return spark.createDataFrame(rows, schema).select(F.col("t").cast("timestamp_ntz").alias("ts"), "client", "endpoint")


def test_alerts_come_once_and_state_ends(spark, tmp_path):
    """Over five starts from one checkpoint: an alert when a limit is passed and none after, late
    calls left out, state freed by the clock of the data alone."""
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    minute = lambda m, n, client="a", endpoint="upload": [(f"2024-01-01 00:{m:02d}:{i:02d}", client, endpoint) for i in range(n)]
    batches = [
        minute(0, 10) + minute(0, 3, "b") + minute(1, 1) + minute(0, 50, "a", "free") + [(None, "a", "upload"), ("2024-01-01 00:00:01", None, "upload")],
        minute(0, 1) + minute(1, 30),  # the 11th call of the first minute, from another batch
        minute(0, 5) + minute(1, 5) + minute(2, 11, "b"),
        minute(30, 1, "c"),  # time goes on: all earlier windows close
        minute(0, 20, "b") + minute(31, 11, "c"),  # too late for b
    ]
    schema, left = None, []
    for rows in batches:
        _calls(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp_ntz, client string, endpoint string").parquet(str(tmp_path / "in"))
        alerts = monitor.breach_alerts(stream, "client", "endpoint", {"upload": 10, "ask": 30}, "5 minutes")
        schema = alerts.schema
        query = sink.write_batches(alerts, path, state, "append")
        query.awaitTermination()
        left.append(query.lastProgress.stateOperators[0].numRowsTotal)
    rows = spark.read.schema(schema).parquet(path).collect()
    assert sorted((r.window_start.minute, r.client, r.allowed, r.batch >= 0) for r in rows) == [
        (0, "a", 10, True), (1, "a", 10, True), (2, "b", 10, True), (31, "c", 10, True)]
    assert left == [2, 2, 2, 1, 1]


def test_alerts_of_many_clients_share_few_states(spark, tmp_path):
    """Sixty clients in four states: each client is counted for itself, over two starts."""
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    for start in (0, 30):  # client i calls i times in all, half of them at each start
        rows = [(f"2024-01-01 00:00:{start + k // 2:02d}", f"c{i}", "upload") for i in range(60) for k in range(i) if k % 2 == (start > 0)]
        _calls(spark, rows).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp_ntz, client string, endpoint string").parquet(str(tmp_path / "in"))
        alerts = monitor.breach_alerts(stream, "client", "endpoint", {"upload": 10}, "5 minutes", groups=4)
        query = sink.write_batches(alerts, path, state, "append")
        query.awaitTermination()
        assert 1 <= query.lastProgress.stateOperators[0].numRowsTotal <= 4
    told = spark.read.schema(alerts.schema).parquet(path).collect()
    assert sorted(r.client for r in told) == sorted(f"c{i}" for i in range(11, 60))


def test_final_windows_and_late_rows(spark, tmp_path):
    """What arrives is either in a final window, late, or in a window that is still open."""
    times = [["00:10", "03:00"], ["00:50", "02:10", "05:00"], ["02:20", "03:30", "05:10"], []]
    for i, part in enumerate(times):
        rows = [(f"2024-01-01 {t}:00", "x", None if i == 1 else "e") for t in part]
        _calls(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp_ntz, client string, endpoint string").parquet(str(tmp_path / "in"))
        for query in monitor.write_final(stream, ["endpoint"], "1 hour", str(tmp_path / "out"), str(tmp_path / "state")):
            query.awaitTermination()
    labels = _calls(spark, rows).select("endpoint").schema
    final = monitor.final_counts(spark, str(tmp_path / "out"), labels)
    late = monitor.late_counts(spark, str(tmp_path / "out"), labels, "1 hour")
    key = lambda r: (r.window_start.hour, r.endpoint or "-")
    assert sorted((*key(r), r.total) for r in final.collect()) == [(0, "e", 1), (2, "-", 1), (3, "e", 1)]
    assert sorted((*key(r), r.late) for r in late.collect()) == [(0, "-", 1), (2, "e", 1), (3, "e", 1)]


def test_uploads_into_a_collection(spark, tmp_path):
    """Files in several batches: repeats, new versions, an older one that comes late, a return to
    what was there before, damaged and unknown files. The result is that of the newest files."""
    import os

    from corpusloom.operators import collection

    path, state, root = str(tmp_path / "stored"), str(tmp_path / "state"), tmp_path / "in"
    long, code = "A sentence about roses. " * 200, "Text.\n\n```python\nx = 1\n```\nEnd."
    rounds = [
        ("1", 100, {"guide.md": code, "notes.txt": long, "bad.docx": "no zip", "skip.exe": "MZ\x00", "blank.txt": " \n"}),
        ("2", 200, {"notes.txt": long, "guide.md": "short now", "new.txt": "new"}),
        ("3", 300, {"guide.md": code}),
        ("4", 150, {"guide.md": "older version", "new.txt": "older"}),
        ("5", 400, {}),
    ]
    outcomes = []
    for folder, at, made in rounds:
        (root / folder).mkdir(parents=True)
        for name, text in made.items():
            (root / folder / name).write_text(text)
            os.utime(root / folder / name, (1_700_000_000 + at, 1_700_000_000 + at))
        ingest.ingest_uploads(ingest.upload_stream(spark, str(root), 100), path, state, buckets=8).awaitTermination()
    for r in ingest.upload_reports(spark, path).collect():
        outcomes.append((r.batch, r.title, r.outcome.split(":")[0], r.chunks))
    rejected = {t: o for _, t, o, _ in outcomes if t in ("bad.docx", "skip.exe")}
    assert set(rejected) == {"bad.docx", "skip.exe"} and "stored" not in rejected.values()
    assert sorted(o for o in outcomes if o[1] not in rejected) == [
        (0, "blank.txt", "empty", None), (0, "guide.md", "stored", 3), (0, "notes.txt", "stored", 6),
        (1, "guide.md", "stored", 1), (1, "new.txt", "stored", 1), (1, "notes.txt", "known", None),
        (2, "guide.md", "stored", 3), (3, "guide.md", "older", None), (3, "new.txt", "older", None)]
    docs = spark.createDataFrame([("guide.md", code), ("notes.txt", long), ("new.txt", "new")], "title string, content string")
    want = ingest.document_chunks(docs).select("id", "content", "total_chunks").collect()
    got = collection.read(spark, path).select("id", "content", "total_chunks").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_repeated_upload_batch_changes_nothing(spark, tmp_path):
    """A batch that died after its write and is run again finds its work done."""
    import shutil

    from corpusloom.operators import collection

    path, state, root = str(tmp_path / "stored"), tmp_path / "state", tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("first text")
    run = lambda: ingest.ingest_uploads(ingest.upload_stream(spark, str(root)), path, str(state), buckets=4).awaitTermination()
    run()
    before = collection.versions(spark, path)
    shutil.rmtree(state / "commits")  # as if it had died before the batch was committed
    run()
    assert collection.versions(spark, path) == before
    assert [r.content for r in collection.read(spark, path).collect()] == ["first text"]


def test_contents_of_uploads_are_not_kept_on_the_way(spark, tmp_path):
    """Only names, times and digests go to scratch tables: contents go once, to the collection."""
    import os
    import random

    from corpusloom import session
    from corpusloom.operators import collection

    def size(folder):
        return sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(folder) for n in names)

    path, root, pick = str(tmp_path / "stored"), tmp_path / "in", random.Random(5)
    root.mkdir()
    for i in range(4):
        (root / f"{i}.txt").write_text(" ".join(f"{pick.getrandbits(64):x}" for _ in range(15_000)))
    scratch = session.own_scratch(spark).removeprefix("file:")
    before = size(scratch)
    ingest.ingest_uploads(ingest.upload_stream(spark, str(root)), path, str(tmp_path / "state"), buckets=4).awaitTermination()
    assert size(scratch) - before < 100_000 < 500_000 < size(f"{path}/rows")
    assert {r.outcome for r in ingest.upload_reports(spark, path).collect()} == {"stored"}
    assert collection.read(spark, path).select("title").distinct().count() == 4
