"""The bucketed cache: it stays where it is, grows, and can be opened again."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import caches

SCHEMA = "key string, entry long"


def entries(spark, low, high):
    return spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").alias("entry"))


def parents(text, line):
    """The operators above a line of a plan."""
    lines, out = text.split("\n"), []
    depth = lambda s: len(re.match(r"[\s:+\-|*()\d]*", s).group(0))
    at = next(i for i, s in enumerate(lines) if line in s)
    low = depth(lines[at])
    for s in reversed(lines[:at]):
        if s.strip() and depth(s) < low:
            low = depth(s)
            out.append(s)
    return out


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path / "cache")
    caches.save_bucketed(entries(spark, 0, 5000), path, 16)
    return path


def test_lookups_do_not_move_the_cache(spark, stored):
    cache = caches.save_bucketed(entries(spark, 5000, 6000), stored, 16, "append")
    rows = spark.range(20_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.sha2(F.lit("7"), 256)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(
            F.sha2(F.col("id").cast("string"), 256)).alias("key"),
    )  # a third of all rows ask for one key
    found = caches.lookup_bucketed(rows, cache, "entry", 16)
    text = found._jdf.queryExecution().executedPlan().toString()
    above = parents(text, "Bucketed: true")
    join = next(i for i, s in enumerate(above) if "SortMergeJoin" in s)
    assert not any("Exchange" in s for s in above[:join])
    want = caches.lookup(rows, entries(spark, 0, 6000), "entry")
    columns = ["id", "key", "entry", "hit"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_open_again(spark, stored):
    spark.sql(f"DROP TABLE {caches._table_name(stored)}")  # as in another application; the files stay
    cache = caches.open_bucketed(spark, stored, entries(spark, 0, 1).schema, 16)
    assert cache.count() == 5000
    rows = entries(spark, 4990, 5010).select("key")
    assert caches.lookup_bucketed(rows, cache, "entry", 16).where("hit").count() == 10
    spark.sql(f"DROP TABLE {caches._table_name(stored)}")
    caches.save_bucketed(entries(spark, 5000, 5010), stored, 16, "append")
    assert caches.lookup_bucketed(rows, caches.open_bucketed(spark, stored, None, 16), "entry", 16).where("hit").count() == 20
    none = caches.lookup_bucketed(rows.limit(0), spark.table(caches._table_name(stored)), "entry", 16)
    assert none.count() == 0
