"""The stored collection: what a write touches, what readers see, failures, statistics."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import collection


def held(frame):
    return sorted(map(str, (r.asDict() for r in frame.collect())))


def files(path):
    out = {}
    for folder, _, names in os.walk(f"{path}/rows"):
        out |= {os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return out


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(10_000).select("id", F.concat(F.lit("old "), "id").alias("content"), (F.col("id") % 7).cast("string").alias("source"))
    collection.create(rows, path, buckets=200, stats_by=("source",))
    return path


def test_a_small_write_touches_few_files(spark, stored):
    before = files(stored)
    new = spark.createDataFrame([(5, "new", 1), (5, "newest", 2), (20_000, "added", 1)], "id long, content string, seq int")
    made = collection.upsert(new, stored)
    after = files(stored)
    assert before.items() <= after.items()  # nothing that was there is written again
    buckets = {os.path.basename(os.path.dirname(f)) for f in after.keys() - before.keys()}
    assert len(buckets) == 2 and made.version == 2
    assert sum(w.startswith("1-") for w in made.folders.values()) == len(made.folders) - 2
    rows = collection.read(spark, stored)
    assert rows.count() == 10_001
    got = {r.id: (r.content, r.source) for r in rows.where("id IN (5, 6, 20000)").collect()}
    assert got == {5: ("newest", None), 6: ("old 6", "6"), 20_000: ("added", None)}
    assert held(collection.read_keys(spark, stored, [5, 20_000])) == held(rows.where("id IN (5, 20000)"))
    scan = collection.read_keys(spark, stored, [5])
    assert len(scan.inputFiles()) == 1


def test_readers_see_all_or_nothing(spark, stored, monkeypatch):
    old = held(collection.read(spark, stored))
    reader = collection.read(spark, stored)  # planned before the write
    new = spark.range(10_000).select("id", F.lit("new").alias("content"), F.lit("s").alias("source"), F.lit(1).alias("seq"))

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(collection, "_publish", dies)
        with pytest.raises(OSError):
            collection.upsert(new, stored)
    assert collection.versions(spark, stored) == [1] and held(collection.read(spark, stored)) == old
    collection.upsert(new, stored)
    assert held(reader) == old == held(collection.read(spark, stored, 1))
    assert {r.content for r in collection.read(spark, stored).collect()} == {"new"}
    assert collection.vacuum(spark, stored, keep=1) == [1]
    assert collection.read(spark, stored).count() == 10_000
    assert len(os.listdir(f"{stored}/rows")) == 1  # the failed write is gone, too


def test_two_writers_at_once(spark, stored):
    stale = collection.manifest(spark, stored)
    new = spark.createDataFrame([(1, "a", 1)], "id long, content string, seq int")
    collection.upsert(new, stored)
    with pytest.raises(collection.Conflict):
        collection._write(spark, stored, collection.read(spark, stored).limit(3), stale, [0], None)
    assert collection.read(spark, stored).where("id = 1").first().content == "a"
    assert collection.read(spark, stored).count() == 10_000
    with pytest.raises(collection.Conflict):
        collection.create(new, stored)


def test_a_repeated_batch_changes_nothing(spark, stored):
    new = spark.createDataFrame([(1, "a", 1)], "id long, content string, seq int")
    first = collection.upsert(new, stored, tag="batch 7")
    assert collection.upsert(new, stored, tag="batch 7") == first == collection.manifest(spark, stored)
    assert collection.upsert(new.limit(0), stored) == first
    assert collection.upsert(new, stored, tag="batch 8").version == first.version + 1


def test_documents_are_replaced_whole_and_never_by_older_ones(spark, tmp_path):
    path = str(tmp_path / "c")
    schema = "id string, title string, content string, at int, seq int"
    rows = [(f"{t}_{i}", t, f"{t}{i} v1", 1, 0) for t in "abc" for i in range(3)] + [("x_0", None, "no title", 1, 0)]
    collection.create(spark.createDataFrame(rows, schema).drop("seq"), path, document_col="title", buckets=16)
    new = [("a_0", "a", "a0 v2", 2, 0), ("b_0", "b", "b0 v0", 0, 0), ("d_0", "d", "d0 v2", 2, 0)]
    collection.upsert(spark.createDataFrame(new, schema), path, replace_document=True, version_col="at")
    got = {r.id: r.content for r in collection.read(spark, path).collect()}
    assert got == {"a_0": "a0 v2", "d_0": "d0 v2", "x_0": "no title"} | {f"{t}_{i}": f"{t}{i} v1" for t in "bc" for i in range(3)}
    with pytest.raises(ValueError):
        collection.create(spark.createDataFrame([(1, 2)], "id int, Bucket int"), str(tmp_path / "d"))


def test_empty_collections(spark, tmp_path):
    path = str(tmp_path / "c")
    none = spark.createDataFrame([], "id long, content string")
    with pytest.raises(FileNotFoundError):
        collection.read(spark, path)
    collection.create(none, path, stats_by=("content",))
    assert collection.read(spark, path).count() == 0 and collection.stored_stats(spark, path).count() == 0
    collection.upsert(spark.createDataFrame([(None, "x", 1), (2, "y", 1)], "id long, content string, seq int"), path)
    assert collection.read(spark, path).count() == 2


def test_statistics_merge(spark, stored):
    """Counts are exact, estimates within three standard errors, and the rows are not read."""
    new = spark.range(9_000, 15_000).select("id", F.lit("n").alias("content"), F.lit("new").alias("source"), F.lit(1).alias("seq"))
    collection.upsert(new, stored)
    stats = collection.stored_stats(spark, stored)
    want = {r.source: r["count"] for r in collection.read(spark, stored).groupBy("source").count().collect()}
    got = {r.value: (r.rows, r.ids) for r in stats.collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(abs(ids - rows) <= 0.05 * rows for rows, ids in got.values())
    assert all("/stats/" in f for f in stats.inputFiles())


def test_rows_of_empty_buckets_are_written_once(spark, tmp_path):
    """No second copy of the rows stays or was published; ids that come twice are settled all the same."""
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([(i % 8, f"v{i}", i) for i in range(12)], "id long, content string, seq int")
    collection.create(rows, path, seq_col="seq")
    want = {i: f"v{i + 8 if i < 4 else i}" for i in range(8)}
    assert {r.id: r.content for r in collection.read(spark, path).collect()} == want
    assert len(os.listdir(f"{path}/rows")) == 1
    made = collection.upsert(spark.createDataFrame([(i, "x", 1) for i in range(100, 104)], "id long, content string, seq int"), path)
    assert made.version == 2 and collection.read(spark, path).count() == 12
    assert {w for w in os.listdir(f"{path}/rows")} == {f"write={w}" for w in made.folders.values()}
