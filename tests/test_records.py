"""Large files cut into records by many tasks, against readers that hold the whole file."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files, records


@pytest.fixture()
def small_splits(spark):
    """Files of a few kilobytes are read by several tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def odd_text(rng, most=60):
    signs = ["a", "b ", '"', "\\", "{", "}", "[", "]", ",", "\n", "\r\n", "é", "日本", '\\"', "}, {", "\t", ":"]
    return "".join(rng.choice(signs) for _ in range(rng.randrange(most)))


def documents(frame):
    rows = frame.select("title", "content", "source", "extra", "read_error").collect()
    return sorted(str((r.title, r.content, r.source, sorted((r.extra or {}).items()), (r.read_error or "").split(":")[0])) for r in rows)


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_of_odd_documents(spark, tmp_path, small_splits, indent):
    rng = random.Random(indent)
    for name in ("a", "b"):
        docs = [
            {"title": f"{name}{i}", "content": odd_text(rng, 400 if i % 9 == 0 else 40), "more": {"x": [odd_text(rng), {"y": i}]}}
            for i in range(120)
        ]
        docs.insert(3, {"title": "long", "content": "}{" * 3000})  # over many splits
        (tmp_path / f"{name}.json").write_text(json.dumps(docs, indent=indent, ensure_ascii=name == "a"))
    path = [str(tmp_path)]
    pieces = spark.read.option("lineSep", "}").text(path)
    assert pieces.rdd.getNumPartitions() > 30
    found = files.read_scraped_large(spark, path)
    assert documents(found) == documents(files.read_scraped(spark, path))
    assert found.where("read_error IS NULL").count() == 242


@pytest.mark.parametrize("text", [
    "[]", " [ ] \n", '[{"title": "a"}]', '\n[ {"title": "a"} , {"title": "b"} ]\n', '[1, {"title": "a"}, "x", null, [2], {"title": "b"}, 3]',
    '{"title": "a"}', "no json", "", '[{"title": "{"}, {}]', "[[{}]]",
])
def test_short_and_odd_arrays(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    got, want = (f(spark, [str(tmp_path / "a.json")]) for f in (files.read_scraped_large, files.read_scraped))
    assert documents(got) == documents(want)
    assert files.read_scraped_large(spark, [str(tmp_path / "absent")]).count() == 0


@pytest.mark.parametrize("text,whole,errors", [
    ('[{"title": "a"}, {"title": "b"', 1, 1), ('[{"title": "a"}, {"title": "b}]', 1, 1), ('[{"title": "a"} {"title": "b"}, {"title": "c"}]', 2, 1),
    ('[{"title": "a"}, {"title": b}, {"title": "c"}]', 2, 1), ('[{"title": "a"}, {"title": "b"}', 2, 0),
])
def test_what_is_whole_before_an_error_is_kept(spark, tmp_path, text, whole, errors):
    (tmp_path / "a.json").write_text(text)
    rows = files.read_scraped_large(spark, [str(tmp_path)]).collect()
    assert (sum(r.read_error is None for r in rows), sum(r.read_error is not None for r in rows)) == (whole, errors)


def test_a_bad_file_is_never_gathered(spark, tmp_path, small_splits, monkeypatch):
    """From an open string on there is no record end; the rest gives one error row without its text."""
    monkeypatch.setattr(records, "TAIL", 1000)
    docs = ['{"title": "%d"}' % i for i in range(200)]
    docs[50] = '{"title": "open}'
    (tmp_path / "a.json").write_text("[" + ",".join(docs) + "]")
    rows = records.json_elements(spark, [str(tmp_path)]).collect()
    assert sum(r.value is None for r in rows) == 1 and len(rows) == 51


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_tables(spark, tmp_path, small_splits, end):
    rng = random.Random(7)
    rows = [[str(i), odd_text(rng).replace("\r", ""), odd_text(rng, 10).replace("\r", "")] for i in range(300)]
    rows[20][1] = "x\n" * 2000  # over many splits
    for name, part in (("a", rows[:200]), ("b", rows[200:])):
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            made = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL)
            made.writerow(["id", "text, with comma", "more"])
            made.writerows(part)
    found, names = files.csv_rows(spark, str(tmp_path))
    assert names == ["id", "text, with comma", "more"]
    got = {int(r.fields[0]): r.fields for r in found.collect()}
    assert {k: [v or "" for v in f] for k, f in got.items()} == {int(r[0]): r for r in rows}
    order = found.orderBy("path", "block", "at").select(F.col("fields")[0]).collect()
    assert [int(r[0]) for r in order] == list(range(300))
    profile = files.large_csv_profile(spark, str(tmp_path)).first()
    assert (profile.rows, profile.columns) == (300, 3) and "... and 290 more rows" in profile.content


def test_odd_tables(spark, tmp_path):
    for name, text, want in (
        ("empty", "", (0, 0)), ("header", "a,b\n", (0, 2)), ("blank", "a,b\n\n1,2\n \n3,4", (2, 2)), ("open", 'a,b\n1,2\n"3,4\n5,6\n', (1, 2)),
        ("short", "a,b\n1\n", (1, 2)),
    ):
        (tmp_path / name).write_text(text)
        row = files.large_csv_profile(spark, str(tmp_path / name)).first()
        assert (row.rows, row.columns) == want, name
    rows, _ = files.csv_rows(spark, str(tmp_path / "open"))
    assert [r.problem for r in rows.orderBy("block", "at").collect()] == [None, "quotes are not closed"]
