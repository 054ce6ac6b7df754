"""Request checks and text expressions, case by case."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import predicates as P
from corpusloom.functions import text as T


def apply(spark, values, expression, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_query(spark):
    cases = {
        "test query": None, "  test   query  ": None, "": "too_short", " \t\n": "too_short",
        "a" * 1000: None, "a" * 1001: "too_long", None: "too_short",
    }
    assert apply(spark, list(cases), P.query_problem, "string") == list(cases.values())
    assert apply(spark, ["  test \n  query  ", " a b"], T.normalise_query, "string") == ["test query", "a b"]


def test_k(spark):
    cases = {1: None, 5: None, 100: None, 0: "too_small", -1: "too_small", 101: "too_large"}
    assert apply(spark, list(cases), P.k_problem, "int") == list(cases.values())
    assert apply(spark, [8, 99, 500], P.clamp_k, "int") == [10, 100, 100]


def test_temperature(spark):
    cases = {0.0: None, 0.5: None, 1.0: None, -0.1: "too_small", 1.1: "too_large", float("nan"): "not_a_number"}
    assert apply(spark, list(cases), P.temperature_problem, "double") == list(cases.values())


def test_max_tokens(spark):
    cases = {100: None, 1000: None, 4000: None, 99: "too_small", 4001: "too_large"}
    assert apply(spark, list(cases), P.max_tokens_problem, "int") == list(cases.values())


FILES = {
    "test.txt": "test.txt",
    "../../etc/passwd": "passwd",
    "%2e%2e%2fpasswd": "passwd",
    "test<>:|?*.txt": "test______.txt",
    "test\0.txt": "test.txt",
    "a%00b.txt": "ab.txt",
    ".hidden": None,
    "..": None,
    ".": None,
    "": None,
    "/": None,
    "dir/": "dir",
    "dir/.": "dir",
    "back\\slash.txt": "back_slash.txt",
    "a+b.txt": "a+b.txt",
    "100%.txt": "100%.txt",
    "50%25%zz.txt": "50%%zz.txt",
    "caf%C3%A9.md": "café.md",
}


def test_file_names(spark):
    assert dict(zip(FILES, apply(spark, list(FILES), T.safe_filename, "string"))) == FILES


def test_suffixes(spark):
    cases = {"a.TXT": ".txt", "a.tar.gz": ".gz", ".hidden": "", "none": "", "dir.d/file": "", "x/.bashrc": ""}
    assert apply(spark, list(cases), T.file_extension, "string") == list(cases.values())


def test_words_and_strip(spark):
    cases = ["", "  ", "one", " two  words\n", "a b c d", "x\x1cy\x85z", "“quoted” – text"]
    assert apply(spark, cases, T.word_count, "string") == [len(c.split()) for c in cases]
    assert apply(spark, cases, T.strip, "string") == [c.strip() for c in cases]


def test_keys_follow_python(spark):
    import hashlib

    text = "  Some TEXT\n"
    want = hashlib.sha256(("m:" + text.strip().lower()).encode()).hexdigest()
    assert apply(spark, [text], lambda c: T.embedding_key(c, "m"), "string") == [want]
    tops = ["x" * 300, "second", "third"]
    digest = hashlib.sha256("".join(t[:200] for t in tops).encode()).hexdigest()[:16]
    want = hashlib.sha256(f"some text_{digest}".encode()).hexdigest()
    got = apply(spark, [text], lambda c: T.response_key(c, F.array(*[F.lit(t) for t in tops])), "string")
    assert got == [want] and len(want) == 64
    want = hashlib.md5(b"content7").hexdigest()[:16]
    assert apply(spark, ["content"], lambda c: T.chunk_id(c, F.lit(7)), "string") == [want]


def test_expand_and_topic(spark):
    assert apply(spark, ["two words", "three short words", ""], T.expand_query, "string") == [
        "two words documentation reference", "three short words", " documentation reference",
    ]
    cases = {"A Python tutorial": "python", "use the API": "web", "web function": "python", "cooking": "general"}
    assert apply(spark, list(cases), T.topic, "string") == list(cases.values())


def test_batch_tier(spark):
    cases = {None: 100, 0.0: 200, 499.9: 200, 500.0: 100, 1999.0: 100, 2000.0: 50, 4999.0: 50, 5000.0: 25}
    assert apply(spark, list(cases), T.batch_tier, "double") == list(cases.values())


def test_fences_and_metadata(spark):
    assert apply(spark, ["x = 1", "see ```x```"], T.fenced_answer, "string") == ["```python\nx = 1\n```", "see ```x```"]
    df = spark.createDataFrame([({"a": None, "b": "1"},)], "m map<string,string>")
    row = df.select(T.clean_metadata("m").alias("m")).select(
        "m", T.field("m", "title", "Unknown").alias("t"), T.field("m", "a", "no").alias("a")
    ).first()
    assert (row.m, row.t, row.a) == ({"a": "", "b": "1"}, "Unknown", "")


@pytest.mark.parametrize("value,want", [(None, False), ("short", False), ("long enough", True)])
def test_cacheable(spark, value, want):
    assert apply(spark, [value], P.cacheable_response, "string") == [want]


def test_cacheable_text(spark):
    assert apply(spark, ["abcd", "abcde", None], P.cacheable_text, "string") == [False, True, False]
