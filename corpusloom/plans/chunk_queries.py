"""Registered chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.operators import chunking, stats
from corpusloom.plans.split_sql import SPACE, WORDS, chunk_select, split_ctes
from corpusloom.plans.tables import derived, documents

SIZE, OVERLAP = C.CHUNK_SIZE, C.CHUNK_OVERLAP

# The given documents hold no fences and no headings; these make whole documents with them.
# ``{t}`` is the text column; the expressions read the same in both engines.
MIXED = (
    "concat({t}, chr(10), '```python', chr(10), replace({t}, '. ', concat('.', chr(10), 'def f():', chr(10))), "
    "chr(10), '```', chr(10), {t}, chr(10), '```sh', chr(10), 'ls', chr(10), '```')"
)
API = (
    "concat(replace({t}, chr(10), concat(chr(10), '### Part ')), chr(10), '## Notes', chr(10), {t}, "
    "chr(10), '### Last', chr(10), {t})"
)
HEADED = (
    "replace(replace(replace({t}, chr(10), concat(chr(10), '# T ', source, chr(10))), "
    "'. ', concat('.', chr(10), '## M ', source, chr(10))), "
    "', ', concat(',', chr(10), '### L ', source, chr(10)))"
)
CORPUS = (
    f"CASE WHEN lang = 'en' THEN {{t}} WHEN lang = 'fr' THEN {MIXED} ELSE {API} END"
)

CHUNK = ("doc_id", "source", "chunk_position", "total_chunks", "chunk_type", "chunk_id", "chunk_size", "word_count", "content")


def recursive_chunks(spark, sf_dir):
    return chunking.chunk_documents(documents(spark, sf_dir)).select(*CHUNK)


def mixed_chunks(spark, sf_dir):
    docs = derived(documents(spark, sf_dir), MIXED.format(t="content"))
    return chunking.chunk_documents(docs).select(*CHUNK)


def api_chunks(spark, sf_dir):
    docs = derived(documents(spark, sf_dir), API.format(t="content"))
    docs = docs.withColumn("doc_type", F.lit("api_reference"))
    return chunking.chunk_documents(docs).select(*CHUNK)


def corpus_chunks(spark, sf_dir):
    """All three routes in one corpus, by language."""
    docs = documents(spark, sf_dir, "doc_id", "source", "lang")
    docs = derived(docs, CORPUS.format(t="content"))
    kind = F.when(F.col("lang").isin("en", "fr"), "page").otherwise("api_reference")
    return chunking.chunk_documents(docs.withColumn("doc_type", kind)).select(*CHUNK)


def fixed_chunks(spark, sf_dir):
    return chunking.fixed_windows(documents(spark, sf_dir)).select(
        "doc_id", "source", "chunk_position", "total_chunks", "chunk_id", "chunk_size", "word_count", "content"
    )


def capped_chunks(spark, sf_dir):
    chunks = chunking.fixed_windows(documents(spark, sf_dir), 100, 20)
    capped = chunking.cap_chunks(chunks, C.MAX_CHUNKS_PER_DOCUMENT)
    return capped.groupBy("doc_id").agg(
        F.count("*").alias("kept"), F.max("total_chunks").alias("total_chunks")
    )


def fence_segments(spark, sf_dir):
    docs = derived(documents(spark, sf_dir), MIXED.format(t="content"))
    return chunking.fence_segments(docs).select("doc_id", "segment_no", "kind", "segment")


def header_sections(spark, sf_dir):
    docs = derived(documents(spark, sf_dir), HEADED.format(t="content"))
    return chunking.header_sections(docs).drop("source")


def chunk_stats(spark, sf_dir):
    out = stats.chunk_stats(chunking.chunk_documents(documents(spark, sf_dir)))
    return out.withColumns(
        {c: F.round(c, 6) for c in ("avg_chunk_size", "avg_word_count")}
    )


def chunk_counts(spark, sf_dir):
    return stats.chunk_counts(corpus_chunks(spark, sf_dir))


def sql_chunks(spark, sf_dir):
    """The chunker as a table function, from SQL."""
    chunking.register_sql(spark)
    documents(spark, sf_dir).createOrReplaceTempView("chunk_input")
    return spark.sql("SELECT doc_id, chunk_position, chunk_type, c.content FROM chunk_input, LATERAL chunk_text(content) c")


QUERIES = {f.__name__: f for f in (
    recursive_chunks, mixed_chunks, api_chunks, corpus_chunks, fixed_chunks, capped_chunks,
    fence_segments, header_sections, chunk_stats, chunk_counts, sql_chunks,
)}


# --- SQL twins -----------------------------------------------------------------------------------


def _plain(docs: str, out: str = "plain") -> str:
    return f"""{out}_src AS (SELECT doc_id AS id, txt FROM {docs}),
{split_ctes(f"{out}_src", f"{out}_s", SIZE, OVERLAP, C.TEXT_SEPARATORS)},
{out} AS (SELECT d.doc_id, d.source, 0 AS seg, s.start, 'text' AS kind, s.content AS piece
  FROM {out}_s s JOIN {docs} d ON s.id = d.doc_id)"""


def _segmented(segments: str, out: str) -> str:
    """Segments (doc_id, source, seg, kind, code, txt): short code and sections stay whole."""
    key = "(doc_id * 1000000 + seg)"
    return f"""{out}_whole AS (SELECT doc_id, source, seg, 0 AS start, kind, txt AS piece
  FROM {segments} WHERE kind <> 'text' AND length(txt) <= {SIZE}),
{out}_src AS (SELECT {key} AS id, txt FROM {segments} WHERE NOT code AND (kind = 'text' OR length(txt) > {SIZE})),
{out}_csrc AS (SELECT {key} AS id, txt FROM {segments} WHERE code AND length(txt) > {SIZE}),
{split_ctes(f"{out}_src", f"{out}_s", SIZE, OVERLAP, C.TEXT_SEPARATORS)},
{split_ctes(f"{out}_csrc", f"{out}_c", SIZE, OVERLAP, C.CODE_SEPARATORS)},
{out} AS (
  SELECT doc_id, source, seg, start, kind, piece FROM {out}_whole
  UNION ALL SELECT g.doc_id, g.source, g.seg, s.start, g.kind, s.content
    FROM (SELECT * FROM {out}_s UNION ALL SELECT * FROM {out}_c) s
    JOIN {segments} g ON s.id = g.doc_id * 1000000 + g.seg)"""


def _fences(docs: str, out: str) -> str:
    """Parts between fence marks: every second one is code (all fences here are closed)."""
    return f"""{out} AS (
  SELECT doc_id, source, n AS seg, n % 2 = 0 AS code, CASE WHEN n % 2 = 0 THEN 'code' ELSE 'text' END AS kind,
         CASE WHEN n % 2 = 0 THEN '```' || part || '```' ELSE part END AS txt
  FROM (SELECT doc_id, source, unnest(parts) AS part, generate_subscripts(parts, 1) AS n
        FROM (SELECT doc_id, source, string_split(txt, '```') AS parts FROM {docs})))"""


def _sections(docs: str, out: str) -> str:
    return f"""{out}_b AS (
  SELECT doc_id, source, n, block, strpos(block, '### ') AS p
  FROM (SELECT doc_id, source, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS n
        FROM (SELECT doc_id, source,
                     string_split(replace(txt, chr(10) || '##', chr(1) || chr(10) || '##'), chr(1)) AS blocks
              FROM {docs}))),
{out}_n AS (SELECT *, coalesce(count(*) FILTER (p > 0) OVER (PARTITION BY doc_id ORDER BY n
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM {out}_b),
{out} AS (
  SELECT doc_id, source, 2 * done AS seg, false AS code, 'api_reference' AS kind, txt FROM (
    SELECT doc_id, source, done,
           string_agg(CASE WHEN p > 0 THEN left(block, p - 1) ELSE block END, '' ORDER BY n) AS txt
    FROM {out}_n GROUP BY doc_id, source, done)
  WHERE trim(txt, {SPACE}) <> ''
  UNION ALL SELECT doc_id, source, 2 * done + 1, false, 'api_reference', substring(block, p)
  FROM {out}_n WHERE p > 0)"""


def _docs(expression: str, name: str = "docs", where: str = "true") -> str:
    return f"{name} AS (SELECT doc_id, source, lang, {expression.format(t='text')} AS txt FROM documents WHERE {where})"


_FENCE_SEGMENTS = f"fence_all AS (SELECT * FROM fence_raw WHERE trim(txt, {SPACE}) <> '')"
RECURSIVE = f"WITH RECURSIVE {_docs('{t}')}, {_plain('docs')} "
MIXED_SQL = f"WITH RECURSIVE {_docs(MIXED)}, {_fences('docs', 'fence_raw')}, {_FENCE_SEGMENTS}, {_segmented('fence_all', 'mixed')} "
API_SQL = f"WITH RECURSIVE {_docs(API)}, {_sections('docs', 'sections')}, {_segmented('sections', 'api')} "
CORPUS_SQL = (
    "WITH RECURSIVE "
    + _docs("{t}", "docs_en", "lang = 'en'") + ", " + _plain("docs_en") + ", "
    + _docs(MIXED, "docs_fr", "lang = 'fr'") + ", " + _fences("docs_fr", "fence_raw") + ", " + _FENCE_SEGMENTS + ", "
    + _segmented("fence_all", "mixed") + ", "
    + _docs(API, "docs_api", "lang NOT IN ('en', 'fr')") + ", " + _sections("docs_api", "sections") + ", "
    + _segmented("sections", "api")
    + ", everything AS (SELECT * FROM plain UNION ALL SELECT * FROM mixed UNION ALL SELECT * FROM api) "
)

_WINDOWS = """wins AS (SELECT doc_id, source, text, n, unnest(range(n)) AS i FROM (
  SELECT doc_id, source, text, (greatest(0, length(text) - {o} - 1) // {step} + 1)::BIGINT AS n
  FROM documents WHERE text <> ''))"""
_FIXED = _WINDOWS.format(o=OVERLAP, step=SIZE - OVERLAP)

ORACLE = {
    "recursive_chunks": RECURSIVE + chunk_select("plain"),
    "sql_chunks": RECURSIVE + f"SELECT doc_id, chunk_position, chunk_type, content FROM ({chunk_select('plain')})",
    "mixed_chunks": MIXED_SQL + chunk_select("mixed"),
    "api_chunks": API_SQL + chunk_select("api"),
    "corpus_chunks": CORPUS_SQL + chunk_select("everything"),
    "fixed_chunks": f"""WITH {_FIXED}
SELECT doc_id, source, i AS chunk_position, n AS total_chunks,
  substring(md5(piece || i::VARCHAR), 1, 16) AS chunk_id, length(piece)::BIGINT AS chunk_size,
  {WORDS.format('piece')}::BIGINT AS word_count, trim(piece, {SPACE}) AS content
FROM (SELECT *, substring(text, i * {SIZE - OVERLAP} + 1, {SIZE}) AS piece FROM wins)""",
    "capped_chunks": f"""WITH {_WINDOWS.format(o=20, step=80)}
SELECT doc_id, count(*) AS kept, max(n) AS total_chunks FROM wins
WHERE i < {C.MAX_CHUNKS_PER_DOCUMENT} GROUP BY doc_id""",
    "fence_segments": f"""WITH {_docs(MIXED)}, {_fences('docs', 'fence_raw')}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS segment_no, kind, txt AS segment
FROM fence_raw WHERE seg < 5""",
    "header_sections": f"""WITH {_docs(HEADED)},
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
  FROM (SELECT doc_id, string_split(txt, chr(10)) AS ls FROM docs)),
marked AS (SELECT *, CASE WHEN line LIKE '# %' THEN 1 WHEN line LIKE '## %' THEN 2 WHEN line LIKE '### %' THEN 3 ELSE 0 END AS lvl FROM lines),
one AS (SELECT *, count(*) FILTER (lvl = 1) OVER (PARTITION BY doc_id ORDER BY n) AS no_1 FROM marked),
two AS (SELECT *, count(*) FILTER (lvl = 2) OVER (PARTITION BY doc_id, no_1 ORDER BY n) AS no_2 FROM one),
three AS (SELECT *, count(*) FILTER (lvl = 3) OVER (PARTITION BY doc_id, no_1, no_2 ORDER BY n) AS no_3 FROM two),
heads AS (SELECT *,
  max(CASE WHEN lvl = 1 THEN trim(line[3:], {SPACE}) END) OVER (PARTITION BY doc_id, no_1) AS header_1,
  max(CASE WHEN lvl = 2 THEN trim(line[4:], {SPACE}) END) OVER (PARTITION BY doc_id, no_1, no_2) AS header_2,
  max(CASE WHEN lvl = 3 THEN trim(line[5:], {SPACE}) END) OVER (PARTITION BY doc_id, no_1, no_2, no_3) AS header_3
  FROM three)
SELECT * FROM (SELECT doc_id, no_1, header_1, no_2, header_2, no_3, header_3,
  trim(string_agg(line, chr(10) ORDER BY n), {SPACE}) AS section
  FROM heads WHERE lvl = 0 GROUP BY doc_id, no_1, header_1, no_2, header_2, no_3, header_3)
WHERE section <> ''""",
    "chunk_stats": RECURSIVE + f"""SELECT count(*) AS total_chunks, round(avg(length(content)), 6) AS avg_chunk_size,
  max(length(content))::BIGINT AS max_chunk_size, min(length(content))::BIGINT AS min_chunk_size,
  round(avg(word_count), 6) AS avg_word_count FROM ({chunk_select('plain')})""",
    "chunk_counts": CORPUS_SQL + f"""SELECT chunk_type, source, count(*) AS chunks, grouping(chunk_type, source)::BIGINT AS "grouping"
FROM ({chunk_select('everything')}) GROUP BY GROUPING SETS ((chunk_type), (source), ())""",
}
