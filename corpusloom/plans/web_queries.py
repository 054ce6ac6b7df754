"""Registered queries over web pages and web results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.operators import hits, search
from corpusloom.plans.tables import documents, pages, table
from corpusloom.sources.web import ENTITIES, page_documents, web_hits

N = C.WEB_RESULTS_PER_QUESTION
# Documents as raw web results: ten neighbours answer one question, the language is the provider.
RAW = {
    "position": "doc_id",
    "query_id": "CAST(floor(doc_id / 10) AS BIGINT)",
    "provider": "CASE WHEN doc_id % 13 = 7 THEN 'fallback' ELSE CASE lang WHEN 'en' THEN 'local_firecrawl' WHEN 'fr' THEN 'duckduckgo_web' ELSE 'duckduckgo' END END",
    "kind": "CASE WHEN doc_id % 13 = 7 THEN CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'web' ELSE 'general' END ELSE CASE lang WHEN 'en' THEN 'page' WHEN 'fr' THEN 'snippet' WHEN 'de' THEN 'abstract' ELSE 'topic' END END",
    "markdown": "CASE WHEN n_chars < 1500 THEN '' ELSE {t} END",
    "content": "CASE WHEN n_chars < 500 THEN NULL WHEN lang = 'fr' THEN split_part({t}, '. ', 1) ELSE {t} END",
    "text": "CASE WHEN lang = 'fr' THEN '' ELSE {t} END",
    "title": "CASE WHEN n_chars > 1000 THEN source END",
    "url": "CASE WHEN n_chars > 300 THEN concat('http://', source) END",
}


def html_documents(spark, sf_dir):
    out = page_documents(pages(spark, sf_dir))
    return out.select(
        "page_id", "url", "title", "content", F.size("links").cast("bigint").alias("links"),
        F.array_join("links", "|").alias("link_list"), "source", "provider",
    )


def html_snippets(spark, sf_dir):
    """The same with the content cut as for search results."""
    return page_documents(pages(spark, sf_dir), C.WEB_CUTS["page"], "web_search", "duckduckgo_web").select(
        "page_id", "content", "source", "provider"
    )


def _raw(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars")
    return docs.select(*[F.expr(e.format(t="content")).alias(n) for n, e in RAW.items()])


def web_results(spark, sf_dir):
    return web_hits(_raw(spark, sf_dir))


def capped_results(spark, sf_dir):
    out = hits.cap_results(web_hits(_raw(spark, sf_dir)), C.WEB_RESULTS_PER_QUESTION)
    return out.select("query_id", "provider", "rank", "position", "score")


def provider_fallback(spark, sf_dir):
    """Questions without a page result are answered by the next provider that has any."""
    return hits.first_provider(web_hits(_raw(spark, sf_dir))).select("query_id", "provider", "rank", "position")


def merged_hits(spark, sf_dir):
    """Vector hits per question with the web results behind them."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = search.label_means(vectors).select(F.col("label").cast("bigint").alias("query_id"), "query_vector")
    found = search.nearest(vectors, asked, C.DEFAULT_SEARCH_K, id_col="vec_id").select(
        "query_id", "rank", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("item"),
        F.round("score", 9).alias("score"),
    )
    web = hits.first_provider(web_hits(_raw(spark, sf_dir))).select(
        "query_id", "rank", F.concat(F.lit("w"), F.col("position").cast("string")).alias("item"), "score"
    )
    return hits.append_hits(found, web)


def merged_sources(spark, sf_dir):
    """Documents and pages as one corpus; columns a source lacks are null."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "source", "lang"
    )
    web = page_documents(pages(spark, sf_dir)).select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "source", "url"
    )
    return hits.merge_sources(docs, web)


QUERIES = {f.__name__: f for f in (
    html_documents, html_snippets, web_results, capped_results, provider_fallback, merged_hits, merged_sources,
)}


def _decoded(c: str) -> str:
    for name, char in ENTITIES:
        c = f"replace({c}, '{name}', " + ("chr(39)" if char == "'" else f"'{char}'") + ")"
    return c


_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_TITLE = f"trim({_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, {_WS})"
_BODY = "html"
for _p in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", "<[^>]*>"):
    _BODY = f"regexp_replace({_BODY}, '{_p}', ' ', 'g')"
_BODY = f"trim(regexp_replace({_decoded(_BODY)}, '\\s+', ' ', 'g'), {_WS})"
_LINKS = "regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1)"

_RAW = ", ".join(f"{e.format(t='text')} AS {n}" for n, e in RAW.items())
_HITS = f"""raw AS (SELECT {_RAW} FROM documents),
body AS (SELECT *, coalesce(nullif(markdown, ''), nullif(content, ''), nullif(text, '')) AS b FROM raw),
web AS (SELECT query_id, position,
    CASE WHEN provider = 'fallback' THEN title WHEN kind = 'topic' THEN string_split(b, '.')[1] WHEN kind = 'page' THEN coalesce(title, 'Local Firecrawl Result')
      WHEN kind = 'snippet' THEN coalesce(title, 'Search Result') ELSE coalesce(title, 'DuckDuckGo Result') END AS title,
    coalesce(url, '') AS url,
    CASE WHEN provider = 'fallback' THEN b ELSE CASE kind WHEN 'page' THEN left(b, 2000) WHEN 'abstract' THEN left(b, 1000) WHEN 'topic' THEN left(b, 800) ELSE trim(b, {_WS}) END END AS content,
    'web_search' AS source, provider,
    CASE kind WHEN 'page' THEN 0.95 WHEN 'snippet' THEN 0.8 WHEN 'abstract' THEN 0.8 WHEN 'topic' THEN 0.7 WHEN 'python' THEN 0.6 WHEN 'web' THEN 0.6 ELSE 0.5 END::DOUBLE AS score
  FROM body WHERE b IS NOT NULL AND (kind <> 'snippet' OR length(trim(b, {_WS})) > 20))"""
_FIRST = """ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY position) AS rank,
  CASE provider WHEN 'local_firecrawl' THEN 1 WHEN 'duckduckgo_web' THEN 3 WHEN 'duckduckgo' THEN 4 ELSE 5 END AS try FROM web {0}),
first AS (SELECT * FROM ranked r WHERE rank <= {1} AND try = (SELECT min(try) FROM ranked s WHERE s.query_id = r.query_id))"""

ORACLE = {
    "html_documents": f"""SELECT page_id, url, coalesce(nullif({_TITLE}, ''), 'Crawled Content') AS title, {_BODY} AS content,
  len({_LINKS})::BIGINT AS links, array_to_string({_LINKS}, '|') AS link_list, 'web_crawl' AS source, 'firecrawl' AS provider FROM pages""",
    "html_snippets": f"SELECT page_id, left({_BODY}, 2000) AS content, 'web_search' AS source, 'duckduckgo_web' AS provider FROM pages",
    "web_results": f"WITH {_HITS} SELECT * FROM web",
    "capped_results": f"WITH {_HITS}, {_FIRST.format('', N)} SELECT query_id, provider, rank, position, score FROM ranked WHERE rank <= {N}",
    "provider_fallback": f"""WITH {_HITS}, {_FIRST.format('', N)}
SELECT query_id, provider, rank, position FROM first""",
    "merged_sources": "SELECT 'd' || doc_id AS id, source, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT 'p' || page_id, 'web_crawl', NULL, url FROM pages",
}


def _merged() -> str:
    from corpusloom.plans.search_queries import _sql

    return f"""WITH vec AS ({_sql('l2', C.DEFAULT_SEARCH_K)}), {_HITS}, {_FIRST.format('', N)}
SELECT query_id::BIGINT AS query_id, rank, 'v' || vec_id AS item, score FROM vec
UNION ALL SELECT query_id, (SELECT count(*) FROM vec v WHERE v.query_id = f.query_id) + rank, 'w' || position, score FROM first f"""


ORACLE["merged_hits"] = _merged()
