"""Web pages and raw search results to documents and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import _col, normalise_query, preview, strip

# Entities decoded in page text; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def visible_text(html: Column | str) -> Column:
    """Text of a page without scripts, styles, comments and tags, white space collapsed."""
    text = F.regexp_replace(_col(html), r"(?is)<script\b.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style\b.*?</style>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    return normalise_query(decode_entities(text))


def page_documents(
    pages: DataFrame, limit: int | None = None, source: str = "web_crawl",
    provider: str = "firecrawl", html: str = "html",
) -> DataFrame:
    """Document per page: title, text, links, and where it comes from. ``limit`` cuts the text
    the way search results are cut; a crawl keeps it whole."""
    title = strip(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    content = visible_text(html)
    carried = [c for c in pages.columns if c != html]
    return pages.select(
        *carried,
        F.coalesce(F.nullif(title, F.lit("")), F.lit("Crawled Content")).alias("title"),
        (preview(content, limit) if limit else content).alias("content"),
        F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1)).alias("links"),
        F.lit(source).alias("source"),
        F.lit(provider).alias("provider"),
    )


def web_hits(raw: DataFrame) -> DataFrame:
    """Raw results of any provider as scored hits.

    Input columns: query_id, position, provider, kind (page, snippet, abstract, topic; for the
    fallback the topic of the question: python, web, general),
    markdown, content, text, title, url. Results without content are dropped, and snippets have
    to be longer than twenty characters.
    """
    body = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("markdown", "content", "text")])
    cut, score, title = body, F.lit(None).cast("double"), F.col("title")
    for kind, chars in C.WEB_CUTS.items():
        cut = F.when(F.col("kind") == kind, preview(body, chars)).otherwise(cut)
    cut = F.when(F.col("kind") == "snippet", strip(body)).otherwise(cut)
    for (provider, kind), value in C.WEB_SCORES.items():
        here = (F.col("provider") == provider) & (F.col("kind") == kind)
        score = F.when(here, F.lit(value)).otherwise(score)
    for (provider, kind), value in C.WEB_TITLES.items():
        here = (F.col("provider") == provider) & (F.col("kind") == kind)
        title = F.when(here, F.coalesce(title, F.lit(value))).otherwise(title)
    for topic, value in C.TOPIC_SCORES.items():
        score = F.when((F.col("provider") == "fallback") & (F.col("kind") == topic), F.lit(value)).otherwise(score)
    title = F.when(F.col("kind") == "topic", F.substring_index(body, ".", 1)).otherwise(title)
    long_enough = (F.col("kind") != "snippet") | (F.length(cut) > C.MIN_SNIPPET_LENGTH)
    return raw.where(body.isNotNull() & long_enough).select(
        "query_id",
        "position",
        title.alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        cut.alias("content"),
        F.lit("web_search").alias("source"),
        "provider",
        score.alias("score"),
    )
