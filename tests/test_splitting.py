"""The offset splitter against a plain one that works on lists of strings."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.splitting import api_sections, code_and_text, pieces, split_text
from corpusloom.operators import chunking, stats


def plain_split(text, size, overlap, separators):
    """Pieces as strings, packed one at a time."""
    for i, sep in enumerate(separators):
        if sep == "" or sep in text:
            break
    finer = separators[i + 1 :]
    if sep == "":
        parts = list(text)
    else:
        first, *rest = text.split(sep)
        parts = [p for p in [first, *(sep + r for r in rest)] if p]
    out, run = [], []

    def pack():
        window = []
        for part in run:
            if window and len("".join(window)) + len(part) > size:
                out.append("".join(window))
                while window and (
                    len("".join(window)) > overlap or len("".join(window)) + len(part) > size
                ):
                    window.pop(0)
            window.append(part)
        if window:
            out.append("".join(window))

    for part in parts:
        if len(part) < size:
            run.append(part)
            continue
        pack()
        run = []
        if finer:
            out.extend(plain_split(part, size, overlap, finer))
        else:
            out.append(part)
    pack()
    return [p.strip() for p in out if p.strip()]


TEXT = st.text(alphabet="ab .\n", max_size=200) | st.text(max_size=80)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(2, 30), st.integers(0, 30))
def test_same_as_plain_splitter(text, size, overlap):
    overlap = min(overlap, size)
    want = plain_split(text, size, overlap, C.TEXT_SEPARATORS) if text else []
    assert split_text(text, size, overlap) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\nclass A", "\ndef f", "\n\tdef g", "\n\n", "\n", " ", "xyz"]), max_size=40))
def test_code_separators(parts):
    text = "".join(parts)
    want = plain_split(text, 12, 4, C.CODE_SEPARATORS) if text else []
    assert split_text(text, 12, 4, C.CODE_SEPARATORS) == want


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(2, 30))
def test_chunks_fit_and_occur(text, size):
    for chunk in split_text(text, size, size // 4):
        assert chunk in text and len(chunk) <= size


@pytest.mark.parametrize("length", [0, 1, 999, 1000, 1001, 5000])
def test_word_lengths(length):
    chunks = split_text("x" * length)
    assert "".join(c[: 1000 if i == 0 else 1000] for i, c in enumerate(chunks[:1])) == "x" * min(length, 1000)
    assert all(len(c) <= 1000 for c in chunks)
    if length > 1000:
        assert chunks[1] == "x" * min(1000, length - 800)


def test_zero_overlap_is_honoured():
    assert split_text("a b c d", 2, 0) == ["a", "b", "c", "d"]


def test_fences():
    text = "one\n```py\ncode\n```\n\n```sh\nls\n```\ntwo\n```open"
    assert list(code_and_text(text)) == [
        ("text", "one\n"),
        ("code", "```py\ncode\n```"),
        ("code", "```sh\nls\n```"),
        # blank text between the fences stays in front of the text that follows
        ("text", "\n\n\ntwo\n```open"),
    ]
    assert list(code_and_text("```a```")) == [("code", "```a```")]
    assert list(code_and_text("```a```" + "```b")) == [("code", "```a```"), ("code", "```b")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["```", "`", " ", "a", "\n", "text"]), max_size=25))
def test_fence_parts_keep_text(parts):
    text = "".join(parts)
    found = list(code_and_text(text))
    rest = "".join(p for _, p in found)
    assert len(rest) <= len(text)
    assert re.sub(r"\s", "", rest) == re.sub(r"\s", "", text)
    for kind, part in found:
        assert kind == "text" or part.startswith("```")


def test_api_sections():
    text = "intro\n### one\nbody\n## gap\nmore\n#### deep\nx\n### last"
    assert list(api_sections(text)) == [
        "intro\n", "### one\nbody", "\n## gap\nmore\n#", "### deep\nx", "### last",
    ]
    assert list(api_sections("no heading")) == ["no heading"]


def test_long_fence_and_section_are_split():
    code = "```python\n" + "\n".join(f"def f{i}():\n    return {i}" for i in range(80)) + "\n```"
    found = list(pieces("see\n" + code, None, 300, 50))
    assert found[0] == ("text", "see") and {k for k, _ in found[1:]} == {"code"}
    assert all(len(p) <= 300 for _, p in found)
    section = "### s\n" + "word " * 200
    found = list(pieces(section, "api_reference", 300, 50))
    assert len(found) > 1 and {k for k, _ in found} == {"api_reference"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "page", "src", "alpha beta. " * 300),
        (2, "api_reference", "src", "x\n### a\none\n### b\ntwo"),
        (3, "page", "src", "before\n```py\nprint(1)\n```\nafter"),
        (4, "page", "src", ""),
        (5, None, None, None),
        (6, None, "other", "  padded \U0001f600 text\n"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, doc_type string, source string, content string")


def test_router(docs):
    rows = chunking.chunk_documents(docs).orderBy("doc_id", "chunk_position").collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {1, 2, 3, 6}
    for found in by_doc.values():
        assert [r.chunk_position for r in found] == list(range(len(found)))
        assert {r.total_chunks for r in found} == {len(found)}
    assert [r.content for r in by_doc[2]] == ["x", "### a\none", "### b\ntwo"]
    assert by_doc[2][0].chunk_size == 2  # before stripping
    assert [r.chunk_type for r in by_doc[3]] == ["text", "code", "text"]
    assert by_doc[6][0].content == "padded \U0001f600 text" and by_doc[6][0].word_count == 3
    assert by_doc[6][0].source == "other"


def test_partitioning_does_not_matter(docs):
    a = chunking.chunk_documents(docs.repartition(1)).collect()
    b = chunking.chunk_documents(docs.repartition(8)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_fixed_windows_forms_agree(spark):
    texts = spark.createDataFrame([(i, "abcdefghij" * i + "\U0001f600") for i in range(12)], "doc_id int, content string")
    for size, overlap in ((10, 3), (10, 5), (10, 8), (7, 0)):
        got = {}
        for r in chunking.fixed_windows(texts, size, overlap).collect():
            got.setdefault(r.doc_id, {})[r.chunk_position] = r.content
        for i, text in texts.collect():
            starts = range(0, max(0, len(text) - overlap - 1) + 1, size - overlap)
            assert [got[i][n] for n in range(len(got[i]))] == [text[s : s + size] for s in starts]


def test_headers_inside_fences_are_text(spark):
    text = "intro\n# One\nbody\n```\n# not a header\n```\n## Two\nmore\n# Three\n### Deep\nend"
    df = spark.createDataFrame([(1, text)], "doc_id int, content string")
    rows = chunking.header_sections(df).orderBy("no_1", "no_2", "no_3").collect()
    assert [(r.header_1, r.header_2, r.header_3, r.section) for r in rows] == [
        (None, None, None, "intro"),
        ("One", None, None, "body\n```\n# not a header\n```"),
        ("One", "Two", None, "more"),
        ("Three", None, "Deep", "end"),
    ]


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "doc_id bigint, content string")
    chunks = chunking.chunk_documents(empty)
    assert chunks.count() == 0
    assert stats.chunk_stats(chunks).first().total_chunks == 0


def test_cap(docs):
    chunks = chunking.fixed_windows(docs.where("doc_id = 1"), 100, 0)
    assert chunking.cap_chunks(chunks, 3).count() == 3


def test_control_characters_stay_in_segments_and_sections(spark):
    text = "a\x01b\x02# c\n\x02# d\n```\n# x\x01\n\x02# y\n```\n# H\x02\n\x01z"
    docs = spark.createDataFrame([(text,)], "content string")
    rows = chunking.fence_segments(docs).orderBy("segment_no").collect()
    assert "".join(r.segment for r in rows) == text and [r.kind for r in rows] == ["text", "code", "text"]
    sections = chunking.header_sections(docs).orderBy("no_1").collect()
    assert [r.section for r in sections] == ["a\x01b\x02# c\n\x02# d\n```\n# x\x01\n\x02# y\n```", "\x01z"]
    assert sections[1].header_1 == "H\x02"


def test_fence_segments_split_a_text_once(spark):
    """By literal marks, with the result of matching the pattern over and over."""
    import random

    pick = random.Random(3)
    texts = ["".join(pick.choices(["`", "``", "```", "a", "\n", "é"], k=pick.randrange(14))) for _ in range(400)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    out = chunking.fence_segments(docs)
    got = sorted((r.id, r.segment_no, r.kind, r.segment) for r in out.collect())
    want = []
    for i, text in enumerate(texts):
        parts = re.split(f"({C.FENCE_PATTERN})", text) if text else []
        want += [(i, n, "code" if p.startswith(C.FENCE) else "text", p) for n, p in enumerate(parts) if p]
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "regexp" not in plan
    shown = chunking.header_sections(docs.where(F.col("id") < 5))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in shown
