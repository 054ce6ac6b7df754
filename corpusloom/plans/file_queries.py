"""Registered queries over extraction: the documents are turned into files of many formats, in
the columns of the binary file source, and extracted again."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.operators import chunking, stats
from corpusloom.plans.flows import upload_chunks
from corpusloom.plans.tables import documents
from corpusloom.session import scratch_path
from corpusloom.sources import files

RTF = "concat('{rtf1\\ansi\\deff0 ', {t}, '\\par \\b0}')"


def _text_files(spark, sf_dir):
    """UTF-8 text, Latin-1 markdown, RTF, and a format nobody knows, by language."""
    docs = documents(spark, sf_dir, "doc_id", "lang")
    rtf = F.concat(F.lit("{\\rtf1\\ansi\\deff0 "), "content", F.lit("\\par \\b0}"))
    suffix = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".MD").when(
        F.col("lang") == "de", ".rtf"
    ).otherwise(".xyz")
    data = F.when(F.col("lang") == "fr", F.encode("content", "ISO-8859-1")).when(
        F.col("lang") == "de", F.encode(rtf, "UTF-8")
    ).otherwise(F.encode("content", "UTF-8"))
    path = F.concat(F.lit("/in/doc_"), F.col("doc_id").cast("string"), suffix)
    return docs.select("doc_id", path.alias("path"), data.alias("content"))


def extract_text_files(spark, sf_dir):
    out = files.extract(_text_files(spark, sf_dir))
    return out.select("doc_id", "filename", "file_type", "format", "content", "success", "error", "encoding")


def rtf_text(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id")
    rtf = F.concat(F.lit("{\\rtf1\\ansi\\deff0 "), F.replace("content", F.lit("\n"), F.lit("\\par ")), F.lit("\\b0}"))
    return docs.select("doc_id", files.rtf_text(rtf).alias("content"))


def extract_summary(spark, sf_dir):
    out = files.extract(_text_files(spark, sf_dir))
    return stats.ingest_summary(out, by=["file_type"])


def file_gate(spark, sf_dir):
    """Known and unknown suffixes, and content with a NUL byte for one of the languages."""
    raw = _text_files(spark, sf_dir).withColumn(
        "content", F.when(F.endswith("path", F.lit(".rtf")), F.concat("content", F.lit(bytearray(b"\x00")))).otherwise(F.col("content"))
    )
    return files.gate(raw).select("doc_id", "problem")


def supported_formats(spark, sf_dir):
    """Documents whose file has a supported format."""
    out = _text_files(spark, sf_dir).select("doc_id", files.file_extension("path").alias("file_type"))
    return out.join(F.broadcast(files.supported_formats(spark)), "file_type").select("doc_id", "file_type", "format")


def _pack(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def _office(kind: str, text: str) -> bytes:
    """A minimal office file with one paragraph, slide or row per line of the text."""
    lines = [escape(line) for line in text.split("\n")]
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    if kind == "docx":
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
        table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        return _pack({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}{table}</w:body></w:document>'})
    if kind == "odt":
        t = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
        return _pack({"content.xml": f'<d xmlns:t="{t}">' + "".join(f"<t:p>{x}</t:p>" for x in lines) + "</d>"})
    if kind == "pptx":
        a, p = (f"http://schemas.openxmlformats.org/{x}/2006/main" for x in ("drawingml", "presentationml"))
        parts = {
            f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
            for i, x in enumerate(lines, 1)
        }
        ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(lines) + 1))
        rels = "".join(f'<Relationship Id="rId{i}" Target="slides/slide{i}.xml"/>' for i in range(1, len(lines) + 1))
        parts["ppt/presentation.xml"] = f'<p:presentation xmlns:p="{p}" xmlns:r="{rel}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>'
        parts["ppt/_rels/presentation.xml.rels"] = f"<Relationships>{rels}</Relationships>"
        return _pack(parts)
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rows = '<row r="1"><c r="A1" t="inlineStr"><is><t>line</t></is></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row>' + "".join(
        f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{x}</t></is></c><c r="B{i}"><v>{i}</v></c></row>' for i, x in enumerate(lines, 2)
    )
    return _pack({
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{rel}"><sheets><sheet name="Lines" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData>{rows}</sheetData></worksheet>',
    })


def _office_files(spark, sf_dir):
    pack = F.pandas_udf(
        lambda kinds, texts: pd.Series([_office(k, t) for k, t in zip(kinds, texts)]), "binary"
    )
    kind = F.when(F.col("lang") == "en", "docx").when(F.col("lang") == "fr", "odt").when(
        F.col("lang") == "de", "pptx"
    ).otherwise("xlsx")
    docs = documents(spark, sf_dir, "doc_id", "lang").withColumn("kind", kind)
    path = F.concat(F.lit("/in/doc_"), F.col("doc_id").cast("string"), F.lit("."), "kind")
    return docs.select("doc_id", path.alias("path"), pack("kind", "content").alias("content"))


def extract_office_files(spark, sf_dir):
    """Text of packed documents; of a workbook only the counts (its preview is laid out)."""
    out = files.extract(_office_files(spark, sf_dir))
    number = lambda name: F.try_element_at("stats", F.lit(name))
    return out.select(
        "doc_id", "format", "success",
        F.when(F.col("format") != "excel", F.col("content")).alias("content"),
        F.coalesce(number("paragraphs"), number("slides"), F.get("sheets", F.lit(0))["rows"]).alias("parts"),
        F.coalesce(number("tables"), number("total_sheets")).alias("tables"),
    )


def csv_profile(spark, sf_dir):
    """Every document as a CSV file with one row per line."""
    docs = documents(spark, sf_dir, "doc_id", "source")
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(","), F.length(x).cast("string")))
    body = F.concat(F.lit("n,chars\n"), F.array_join(lines, "\n"), F.lit("\n"))
    path = F.concat(F.lit("/in/doc_"), F.col("doc_id").cast("string"), F.lit(".csv"))
    raw = docs.select("doc_id", path.alias("path"), F.encode(body, "UTF-8").alias("content"))
    out = files.extract(raw)
    return out.select(
        "doc_id", F.try_element_at("stats", F.lit("rows")).alias("rows"),
        F.try_element_at("stats", F.lit("columns")).alias("columns"),
        F.array_join("column_names", ",").alias("column_names"),
        F.element_at(F.split("content", "\n"), 1).alias("first_line"),
        F.contains("content", F.lit("more rows")).alias("cut"),
    )


def saved_chunks(spark, sf_dir):
    """Chunks written as JSON with their statistics and read back."""
    chunks = chunking.fixed_windows(documents(spark, sf_dir, "doc_id")).select("doc_id", "chunk_position", "chunk_id", "word_count", "content")
    path = scratch_path(spark, "saved")
    files.save_chunks(chunks, path)
    return files.load_chunks(spark, path, chunks.schema)


def scraped_documents(spark, sf_dir):
    """Documents as JSON array files of a bounded number of documents each, in two folders, one
    of them by another name in the list of sources, and one source that is not there."""
    docs = documents(spark, sf_dir, "doc_id", "lang", "source").select(
        F.floor(F.col("doc_id") / 500).cast("bigint").alias("part"), "lang",
        F.struct(
            F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "content", "source",
            F.col("doc_id").cast("double").alias("scraped_at"), F.col("lang").alias("language"),
            F.struct(F.col("doc_id").alias("id")).alias("about"),
        ).alias("doc"),
    )
    paths = []
    for label, keep in (("first", F.col("lang") == "en"), ("second", F.col("lang") != "en")):
        arrays = docs.where(keep).groupBy("part").agg(F.to_json(F.collect_list("doc")).alias("value"))
        paths.append(scratch_path(spark, f"scraped-{label}"))
        arrays.write.partitionBy("part").text(paths[-1])
    found = files.read_scraped(spark, [paths[0], scratch_path(spark, "absent"), paths[1]])
    return found.select(
        "title", "content", "source", "doc_type", "scraped_at", "read_error",
        F.get_json_object(F.try_element_at("extra", F.lit("about")), "$.id").alias("about_id"),
        F.replace(F.try_element_at("extra", F.lit("language")), F.lit('"'), F.lit("")).alias("language"),
        F.size("extra").cast("bigint").alias("other_keys"),
    )


def _large_files(docs) -> int:
    """Number of large files that the documents go to: two splits of a scan for each, so that no task
    writes a share that grows with the table."""
    return max(3, docs.rdd.getNumPartitions() // 2)


def _large_arrays(spark, sf_dir):
    """All documents as large JSON array files without a line end; some texts look like JSON."""
    docs = documents(spark, sf_dir, "doc_id", "lang", "source")
    noise = F.when(F.col("lang") == "fr", F.concat(F.lit('{"a": "}, {\\" ['), "content")).otherwise(F.col("content"))
    rows = docs.select(F.to_json(F.struct(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), noise.alias("content"), "source",
        F.struct(F.col("doc_id").alias("id"), F.array(F.lit("x"), "lang").alias("tags")).alias("about"),
    )).alias("value"))

    def laid_out(batches):
        begun = False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            marks = ["," if begun or i else "[" for i in range(len(texts))]
            begun = begun or bool(texts)
            yield pa.RecordBatch.from_pydict({"value": pa.array([m + t for m, t in zip(marks, texts)], pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array(["]" if begun else "[]"])})

    path = scratch_path(spark, "arrays")
    rows.coalesce(_large_files(docs)).mapInArrow(laid_out, "value string").write.option("lineSep", " ").text(path)
    return path


def scraped_large(spark, sf_dir):
    """Documents from arrays of any size, each cut by many tasks."""
    found = files.read_scraped_large(spark, [_large_arrays(spark, sf_dir), scratch_path(spark, "absent")])
    return found.select(
        "title", F.md5("content").alias("digest"), "source", "read_error",
        F.get_json_object(F.try_element_at("extra", F.lit("about")), "$.id").alias("about_id"),
        F.get_json_object(F.try_element_at("extra", F.lit("about")), "$.tags[1]").alias("tag"),
    )


def _large_table(spark, sf_dir):
    """All documents as CSV, with line ends, quotes and commas in the fields."""
    docs = documents(spark, sf_dir, "doc_id", "lang").withColumn("content", F.concat("content", F.lit('\n"quoted", and more\n')))
    path = scratch_path(spark, "table")
    docs.repartitionByRange(_large_files(docs), "doc_id").sortWithinPartitions("doc_id").select("doc_id", "content", "lang").write.option(
        "header", True
    ).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def csv_large_profile(spark, sf_dir):
    """Counts and names of a CSV of any size, and the number of lines in its preview."""
    out = files.large_csv_profile(spark, _large_table(spark, sf_dir))
    return out.select("rows", "columns", F.array_join("column_names", ",").alias("names"), F.contains("content", F.lit("Data Preview")).alias("preview"))


def csv_large_rows(spark, sf_dir):
    """Every row of such a CSV."""
    rows, _ = files.csv_rows(spark, _large_table(spark, sf_dir))
    return rows.select(
        F.col("fields")[0].cast("bigint").alias("doc_id"), F.md5(F.col("fields")[1]).alias("digest"), F.col("fields")[2].alias("lang"), "problem"
    )


def saved_counts(spark, sf_dir):
    """Chunks by type and by source, from what is saved beside them."""
    docs = documents(spark, sf_dir, "doc_id", "source")
    chunks = chunking.fixed_windows(docs).withColumn("chunk_type", F.concat(F.lit("part "), F.least("chunk_position", F.lit(2)).cast("string")))
    path = scratch_path(spark, "saved")
    files.save_chunks(chunks.select("doc_id", "source", "chunk_type", "content", "word_count"), path)
    return files.load_counts(spark, path)


def same_named_files(spark, sf_dir):
    """Pairs of documents as files of one name in two folders: the one changed last is stored."""
    docs = documents(spark, sf_dir, "doc_id", "lang")
    name = F.concat(F.lit("/doc_"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".txt"))
    made = F.timestamp_seconds(F.when(F.col("doc_id") % 6 < 2, F.lit(0)).otherwise(F.col("doc_id") % 5))
    raw = docs.select(
        "doc_id", F.concat(F.lit("/in/"), (F.col("doc_id") % 2).cast("string"), name).alias("path"),
        made.alias("modificationTime"), F.encode("content", "UTF-8").alias("content"),
    )
    _, report = upload_chunks(raw)
    return report.select("doc_id", "filename", "success", "superseded")


QUERIES = {f.__name__: f for f in (
    extract_text_files, rtf_text, extract_summary, file_gate, supported_formats, extract_office_files,
    csv_profile, saved_chunks, saved_counts, scraped_documents, scraped_large, csv_large_profile, csv_large_rows,
    same_named_files,
)}

_RTF = "replace(regexp_replace(regexp_replace({0}, '\\\\[a-z]+\\d*\\s?', '', 'g'), '[{{}}]', '', 'g'), '\\', '')"
_KIND = "CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.MD' WHEN 'de' THEN '.rtf' ELSE '.xyz' END"
_WIN = "regexp_matches(text, '[^\\x00-\\x7f]')"
_LINES = "string_split(text, chr(10))"
_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

ORACLE = {
    "scraped_large": """SELECT 'doc ' || doc_id AS title, md5(CASE WHEN lang = 'fr' THEN '{"a": "}, {\\" [' || text ELSE text END) AS digest, source,
  NULL::VARCHAR AS read_error, doc_id::VARCHAR AS about_id, lang AS tag FROM documents""",
    "csv_large_profile": "SELECT count(*) AS rows, 3::BIGINT AS columns, 'doc_id,content,lang' AS names, true AS preview FROM documents",
    "csv_large_rows": """SELECT doc_id, md5(text || chr(10) || '"quoted", and more' || chr(10)) AS digest, lang, NULL::VARCHAR AS problem FROM documents""",
    "scraped_documents": """SELECT 'doc ' || doc_id AS title, text AS content, source, NULL::VARCHAR AS doc_type, doc_id::DOUBLE AS scraped_at,
  NULL::VARCHAR AS read_error, doc_id::VARCHAR AS about_id, lang AS language, 2::BIGINT AS other_keys FROM documents""",
    "saved_counts": """WITH w AS (SELECT source, unnest(range(greatest(0, length(text) - 201) // 800 + 1)) AS i FROM documents WHERE text <> ''),
k AS (SELECT 'part ' || least(i, 2) AS chunk_type, source FROM w)
SELECT chunk_type, NULL::VARCHAR AS source, count(*) AS chunks, 1::BIGINT AS grouping FROM k GROUP BY chunk_type
UNION ALL SELECT NULL, source, count(*), 2 FROM k GROUP BY source UNION ALL SELECT NULL, NULL, count(*), 3 FROM k""",
    "same_named_files": """WITH f AS (SELECT doc_id, 'doc_' || doc_id // 2 || '.txt' AS filename, CASE WHEN doc_id % 6 < 2 THEN 0 ELSE doc_id % 5 END AS made FROM documents)
SELECT doc_id, filename, true AS success, row_number() OVER (PARTITION BY filename ORDER BY made DESC, doc_id % 2 DESC) > 1 AS superseded FROM f""",
    "extract_text_files": f"""SELECT doc_id, 'doc_' || doc_id || {_KIND} AS filename, lower({_KIND}) AS file_type,
  CASE lang WHEN 'en' THEN 'text' WHEN 'fr' THEN 'text' WHEN 'de' THEN 'rtf' END AS format,
  CASE lang WHEN 'en' THEN text WHEN 'fr' THEN text WHEN 'de' THEN {_RTF.format("'{\\rtf1\\ansi\\deff0 ' || text || '\\par \\b0}'")} ELSE '' END AS content,
  lang IN ('en', 'fr', 'de') AS success, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'Unsupported format: .xyz' END AS error,
  CASE WHEN lang = 'fr' AND {_WIN} THEN 'latin-1' END AS encoding FROM documents""",
    "rtf_text": f"SELECT doc_id, {_RTF.format(chr(39) + '{' + chr(92) + 'rtf1' + chr(92) + 'ansi' + chr(92) + 'deff0 ' + chr(39) + ' || replace(text, chr(10), ' + chr(39) + chr(92) + 'par ' + chr(39) + ') || ' + chr(39) + chr(92) + 'b0}' + chr(39))} AS content FROM documents",
    "extract_summary": f"""SELECT lower({_KIND}) AS file_type, count(*) AS documents, count(*) FILTER (lang IN ('en', 'fr', 'de')) AS succeeded,
  count(*) FILTER (lang NOT IN ('en', 'fr', 'de')) AS failed FROM documents GROUP BY ALL""",
    "file_gate": "SELECT doc_id, CASE lang WHEN 'en' THEN NULL WHEN 'fr' THEN NULL WHEN 'de' THEN 'bad_content' ELSE 'unsupported_type' END AS problem FROM documents",
    "supported_formats": f"""SELECT doc_id, lower({_KIND}) AS file_type, CASE lang WHEN 'de' THEN 'rtf' ELSE 'text' END AS format
FROM documents WHERE lang IN ('en', 'fr', 'de')""",
    "extract_office_files": f"""SELECT doc_id, CASE lang WHEN 'en' THEN 'docx' WHEN 'fr' THEN 'odt' WHEN 'de' THEN 'powerpoint' ELSE 'excel' END AS format, true AS success,
  CASE lang
    WHEN 'en' THEN array_to_string(list_append(list_filter({_LINES}, lambda x: trim(x, {_WS}) <> ''), chr(10) || '[Table]' || chr(10) || 'a | b'), chr(10) || chr(10))
    WHEN 'fr' THEN array_to_string(list_filter(list_transform({_LINES}, lambda x: trim(x, {_WS})), lambda x: x <> ''), chr(10))
    WHEN 'de' THEN array_to_string(list_transform({_LINES}, lambda x, i: chr(10) || '[Slide ' || i || ']' || CASE WHEN trim(x, {_WS}) <> '' THEN chr(10) || trim(x, {_WS}) ELSE '' END), chr(10)) END AS content,
  CASE WHEN lang <> 'fr' THEN len({_LINES}) END AS parts, CASE WHEN lang = 'en' THEN 1 WHEN lang NOT IN ('fr', 'de') THEN 1 END::BIGINT AS tables FROM documents""",
    "csv_profile": f"""SELECT doc_id, len({_LINES}) AS rows, 2::BIGINT AS columns, 'n,chars' AS column_names,
  'CSV Data with ' || len({_LINES}) || ' rows and 2 columns' AS first_line, len({_LINES}) > 10 AS cut FROM documents""",
    "saved_chunks": f"""WITH w AS (SELECT doc_id, text, unnest(range(greatest(0, length(text) - 201) // 800 + 1)) AS i FROM documents WHERE text <> '')
SELECT doc_id, i AS chunk_position, substring(md5(p || i), 1, 16) AS chunk_id,
  len(list_filter(string_split_regex(p, '\\s+'), lambda w: w <> ''))::BIGINT AS word_count, trim(p, {_WS}) AS content
FROM (SELECT *, substring(text, i * 800 + 1, 1000) AS p FROM w)""",
}
