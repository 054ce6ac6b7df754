"""Extraction from real files in a folder, and the JSON readers and writers."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.file_queries import _office
from corpusloom.operators import chunking
from corpusloom.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    sub = root / "deep" / "er"
    sub.mkdir(parents=True)
    (root / "test.txt").write_text("One sentence.", encoding="utf-8")
    (root / "utf.MD").write_bytes("café\r\nx".encode())
    (root / "latin.md").write_bytes("café".encode("latin-1"))
    (root / "bad.rtf").write_bytes(b"{\\rtf1 \xff}")
    (root / "ok.rtf").write_bytes(b"{\\rtf1\\ansi Hello \\b bold\\b0 text}")
    (root / "five.csv").write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(5)))
    (sub / "long.csv").write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(25)))
    (root / "empty.csv").write_text("")
    (root / "blank.csv").write_text("\n")
    (root / "book.xlsx").write_bytes(_office("xlsx", "p\nq"))
    (root / "doc.docx").write_bytes(_office("docx", "first\n\nsecond & third"))
    (root / "slides.pptx").write_bytes(_office("pptx", "\n".join(f"s{i}" for i in range(1, 12))))
    (root / "text.odt").write_bytes(_office("odt", " a \n\nb"))
    (root / "broken.docx").write_bytes(b"PK\x03\x04 not a zip")
    (root / "old.doc").write_bytes(b"\xd0\xcf\x11\xe0")
    (root / "report.pdf").write_bytes(b"%PDF-1.4")
    return root


@pytest.fixture(scope="module")
def found(spark, folder):
    out = files.extract(files.read_files(spark, str(folder)))
    return {r.filename: r for r in out.collect()}


def test_every_file_gives_a_row(found, folder):
    # Spark's file sources make no row for a file of zero length.
    assert len(found) == 15 and "empty.csv" not in found
    failed = {n for n, r in found.items() if not r.success}
    assert failed == {"bad.rtf", "blank.csv", "broken.docx", "old.doc", "report.pdf"}
    assert all(r.content == "" and r.error for n, r in found.items() if n in failed)


def test_text(found):
    assert found["test.txt"].content == "One sentence." and found["test.txt"].encoding is None
    assert found["utf.MD"].content == "café\r\nx" and found["utf.MD"].file_type == ".md"
    assert (found["latin.md"].content, found["latin.md"].encoding) == ("café", "latin-1")
    assert found["ok.rtf"].content == "Hello boldtext"


def test_csv(found):
    five, long = found["five.csv"], found["long.csv"]
    assert five.stats == {"rows": 5, "columns": 2} and five.column_names == ["a", "b"]
    assert five.content.startswith("CSV Data with 5 rows and 2 columns\n\nColumns: a, b\n\nData Preview:\n")
    assert "more rows" not in five.content
    assert long.content.endswith("\n\n... and 15 more rows") and "x9" in long.content and "x10" not in long.content


def test_office(found):
    assert found["doc.docx"].content == "first\n\nsecond & third\n\n\n[Table]\na | b"
    assert found["doc.docx"].stats == {"paragraphs": 3, "tables": 1}
    slides = found["slides.pptx"]
    assert slides.stats == {"slides": 11}
    assert slides.content == "\n".join(f"\n[Slide {i}]\ns{i}" for i in range(1, 12))
    assert found["text.odt"].content == "a\nb"
    book = found["book.xlsx"]
    assert [s.asDict() for s in book.sheets] == [{"name": "Lines", "rows": 2, "columns": 2}]
    assert book.content.startswith("\n[Sheet: Lines]\nRows: 2, Columns: 2\nColumns: line, n\n\nData Preview:\n")
    assert "Unsupported format: .pdf" == found["report.pdf"].error


def test_merged_cells(tmp_path):
    from corpusloom.sources.office import docx

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    body = (
        "<w:tbl><w:tr>" + cell("wide", '<w:gridSpan w:val="2"/>') + cell("tall", '<w:vMerge w:val="restart"/>') + "</w:tr>"
        "<w:tr>" + cell("a") + cell("b") + cell("", "<w:vMerge/>") + "</w:tr></w:tbl>"
    )
    path = tmp_path / "m.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    assert docx(path.read_bytes())["content"] == "\n[Table]\nwide | wide | tall\na | b | tall"


def test_gate(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r.problem for r in files.gate(files.read_files(spark, str(folder))).select("path", "problem").collect()}
    assert {n for n, p in got.items() if p} == {"old.doc", "report.pdf"}
    raw = spark.createDataFrame([("/a.txt", bytearray(b"x\x00y")), ("/b.docx", bytearray(b"PK\x03\x04\x00"))], "path string, content binary")
    assert [r.problem for r in files.gate(raw).orderBy("path").collect()] == ["bad_content", None]


def test_scraped_json(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"title": "t", "content": "body", "scraped_at": 31775.5, "source": "s"}]))
    (tmp_path / "two.json").write_text(json.dumps([{"title": "u", "content": "b2", "doc_type": "api_reference"}, {"content": "b3"}], indent=2))
    paths = [str(tmp_path / n) for n in ("one.json", "absent.json", "two.json")]
    rows = files.read_scraped(spark, paths).orderBy("content").collect()
    assert [(r.title, r.content, r.scraped_at) for r in rows] == [("u", "b2", None), (None, "b3", None), ("t", "body", 31775.5)]
    assert files.read_scraped(spark, [str(tmp_path / "none.json")]).count() == 0


def test_scraped_json_keeps_other_keys_and_reports_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"content": "x", "tags": ["p", 1], "version": 2}, {"content": "y"}, 7]))
    (tmp_path / "b.json").write_text("[{broken")
    (tmp_path / "c.json").write_text("[]")
    rows = files.read_scraped(spark, [str(tmp_path)]).collect()
    good = sorted((r.content, r.extra) for r in rows if r.read_error is None)
    assert good == [("x", {"tags": '["p",1]', "version": "2"}), ("y", None)]
    bad = sorted(r.read_error.rsplit("/", 1)[1] for r in rows if r.read_error)
    assert bad == ["a.json", "b.json"] and all(r.content is None for r in rows if r.read_error)
    chunks = chunking.chunk_documents(files.read_scraped(spark, [str(tmp_path)])).collect()
    assert sorted((c.content, c.extra) for c in chunks) == good


def test_files_of_one_name(spark, tmp_path):
    from corpusloom.plans import flows

    for folder, text, time in (("a", "the old text", 1000), ("b", "the new text", 2000)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "readme.md").write_text(text)
        import os

        os.utime(tmp_path / folder / "readme.md", (time, time))
    chunks, report = flows.upload_chunks(files.read_files(spark, str(tmp_path)), at=F.timestamp_seconds(F.lit(5)))
    assert [(r.id, r.content) for r in chunks.collect()] == [("upload_readme.md_0", "the new text")]
    assert sorted((r.content, r.superseded) for r in report.collect()) == [("the new text", False), ("the old text", True)]
    assert {r.upload_timestamp.timestamp() for r in chunks.select(F.col("upload_timestamp").cast("timestamp")).collect()} == {5.0}


def test_save_chunks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta")], "doc_id int, content string")
    chunks = chunking.chunk_documents(docs)
    files.save_chunks(chunks, str(tmp_path / "out"))
    assert files.load_chunks(spark, str(tmp_path / "out"), chunks.schema).collect() == chunks.collect()
    stats = spark.read.json(str(tmp_path / "out" / "chunk_stats")).first()
    assert (stats.total_chunks, stats.max_chunk_size) == (1, 10)


def test_large_csv(spark, tmp_path, folder):
    row = files.large_csv_profile(spark, str(folder / "deep" / "er" / "long.csv")).first()
    assert (row.rows, row.columns, row.column_names) == (25, 2, ["a", "b"])
    assert "... and 15 more rows" in row.content
