"""Registered queries over text embedding and ranking by terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import embedding_key
from corpusloom.operators import embedding, postings
from corpusloom.plans import flows
from corpusloom.plans.flows import search_texts
from corpusloom.plans.tables import documents, table
from corpusloom.session import scratch_path, written


def _docs(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "source").withColumnRenamed("content", "text")


def term_topk(spark, sf_dir):
    """All benchmark texts as questions over all documents."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )
    out = embedding.term_search(_docs(spark, sf_dir), asked, 5)
    return out.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


def indexed_topk(spark, sf_dir):
    """The same ranking from a stored index, to which the labelled documents were added first."""
    path = scratch_path(spark, "index")
    docs, labelled = _docs(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id")
    for kind in ("left_semi", "left_anti"):
        postings.add(docs.join(labelled, "doc_id", kind), path, segment=64)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    out, _ = postings.search(spark, path, asked, 5)
    return out.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


def document_frequencies(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(embedding.terms("text")).alias("term"))
    return embedding.document_frequencies(_docs(spark, sf_dir), words.distinct())


def _embedded(spark, sf_dir):
    """All documents, with a cache that knows the texts of the labelled ones."""
    docs = _docs(spark, sf_dir)
    model = embedding.fit_vectoriser(docs)
    vectoriser = lambda frame: embedding.vectorise(frame, model)
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    known = vectoriser(labelled.select("text").distinct()).select(
        embedding_key("text").alias("key"), "embedding"
    )
    # Texts that differ only in case or outer space share a key.
    cache = written(known.groupBy("key").agg(F.first("embedding").alias("embedding")), "embedding-cache")
    return embedding.embed_with_cache(docs, cache, vectoriser)


def hashed_embed(spark, sf_dir):
    """Vectors, each told by its size, its components that are not zero, its length, and a sum in
    which every component has a weight of its own."""
    rows, _ = _embedded(spark, sf_dir)
    zero, add = F.lit(0.0), lambda a, x: a + x
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    placed = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return rows.select(
        "doc_id", F.size("embedding").cast("bigint").alias("dims"),
        F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("slots"),
        F.round(F.sqrt(F.aggregate(squares, zero, add)), 4).alias("norm"),
        F.round(F.aggregate(placed, zero, add), 3).alias("checksum"),
    )


def model_hook(spark, sf_dir):
    """A function of the caller's as the model: length and number of words of each text."""
    embed = embedding.model_hook(lambda texts: [[float(len(t)), float(len(t.split(" ")))] for t in texts])
    cache = spark.createDataFrame([], "key string, embedding array<float>")
    rows, _ = embedding.embed_with_cache(_docs(spark, sf_dir), cache, embed)
    return rows.select("doc_id", *[F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate(("chars", "words"))])


def embed_new_entries(spark, sf_dir):
    """What the cache gains: one entry for every distinct text it did not know."""
    _, new = _embedded(spark, sf_dir)
    return new.select("key", "text_length")


def text_search(spark, sf_dir):
    """Question texts to hits: normalise, expand, embed, search."""
    docs = _docs(spark, sf_dir)
    model = embedding.fit_vectoriser(docs)
    vectors = embedding.vectorise(docs.select("doc_id", "text"), model).select("doc_id", "embedding")
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    hits = search_texts(vectors, asked, model, C.DEFAULT_SEARCH_K, id_col="doc_id")
    return hits.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def ask_prompts(spark, sf_dir):
    """Questions to prompts, end to end: validate, embed, search, put the context together."""
    docs = _docs(spark, sf_dir)
    model = embedding.fit_vectoriser(docs)
    rows = embedding.vectorise(docs, model)
    stored = written(rows.select("doc_id", "source", "text", "embedding"), "collection")
    collection = stored.select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), "embedding"
    )
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    made, _ = flows.ask(collection, asked, model, "openai")
    return made.select("query_id", "prompt")


QUERIES = {f.__name__: f for f in (
    term_topk, indexed_topk, document_frequencies, hashed_embed, model_hook, embed_new_entries, text_search, ask_prompts,
)}

_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_SLOT = f"('0x' || substr(md5(term), 1, 8))::BIGINT % {C.EMBEDDING_DIM}"
_VECTORS = f"""counts AS (SELECT doc_id, slot, count(*) AS tf
  FROM (SELECT doc_id, {_SLOT} AS slot FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents)) GROUP BY ALL),
weights AS (SELECT slot, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (count(*) + 1)) AS w FROM counts GROUP BY slot),
weighted AS (SELECT doc_id, slot, tf * w AS x FROM counts JOIN weights USING (slot)),
vectors AS (SELECT doc_id, slot, (x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)))::FLOAT AS value FROM weighted)"""
_KEY = f"sha256('default:' || lower(trim(text, {_WS})))"

ORACLE = {
    "term_topk": f"""WITH dt AS (SELECT doc_id, term, 1 + ln(count(*)) AS w
  FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY doc_id, term),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dt GROUP BY doc_id),
dfs AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
qt AS (SELECT query_id, t.term, (1 + ln(tf)) * ln((SELECT count(*) FROM documents)::DOUBLE / df) AS w
  FROM (SELECT item_id AS query_id, term, count(*) AS tf
        FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL) t JOIN dfs ON t.term = dfs.term),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qt GROUP BY query_id),
scored AS (SELECT qt.query_id, dt.doc_id, round(sum(qt.w * dt.w) / any_value(qn.norm * norms.norm), 9) AS score
  FROM qt JOIN dt ON qt.term = dt.term JOIN qn ON qn.query_id = qt.query_id JOIN norms ON norms.doc_id = dt.doc_id
  GROUP BY qt.query_id, dt.doc_id)
SELECT query_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 5""",
    "document_frequencies": f"""SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents)
WHERE term IN (SELECT unnest({_TERMS}) FROM benchmark) GROUP BY term""",
    "hashed_embed": f"""WITH {_VECTORS} SELECT d.doc_id, {C.EMBEDDING_DIM}::BIGINT AS dims, count(value) AS slots,
  coalesce(round(sqrt(sum(value::DOUBLE * value::DOUBLE)), 4), 0) AS norm, coalesce(round(sum(value::DOUBLE * (slot + 1)), 3), 0) AS checksum
FROM documents d LEFT JOIN (SELECT * FROM vectors WHERE value <> 0) v ON v.doc_id = d.doc_id GROUP BY d.doc_id""",
    "model_hook": f"""WITH k AS (SELECT doc_id, {_KEY} AS key, text FROM documents),
f AS (SELECT key, arg_min(text, doc_id) AS text FROM k GROUP BY key)
SELECT doc_id, length(f.text)::DOUBLE AS chars, len(string_split(f.text, ' '))::DOUBLE AS words FROM k JOIN f USING (key)""",
    "text_search": f"""WITH {_VECTORS}, asked AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), {_WS}) AS q FROM benchmark
  WHERE length(trim(text, {_WS})) >= 1 AND length(text) <= 1000),
expanded AS (SELECT item_id, CASE WHEN len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) < 3
  THEN q || ' documentation reference' ELSE q END AS text FROM asked),
qc AS (SELECT item_id, slot, count(*) AS tf FROM (SELECT item_id, {_SLOT} AS slot FROM (SELECT item_id, unnest({_TERMS}) AS term FROM expanded)) GROUP BY ALL),
qw AS (SELECT item_id, slot, tf * coalesce(w, (SELECT ln(count(*) + 1.0::DOUBLE) FROM documents)) AS x FROM qc LEFT JOIN weights USING (slot)),
qv AS (SELECT item_id, slot, (x / sqrt(sum(x * x) OVER (PARTITION BY item_id)))::FLOAT::DOUBLE AS q FROM qw),
pairs AS (SELECT item_id, doc_id, sum(q * value::DOUBLE) AS common FROM qv JOIN vectors USING (slot) GROUP BY ALL),
qn AS (SELECT item_id, sum(q * q) AS qq FROM qv GROUP BY item_id),
dn AS (SELECT doc_id, sum(value::DOUBLE * value::DOUBLE) AS dd FROM vectors GROUP BY doc_id),
found AS (SELECT qn.item_id AS query_id, d.doc_id, round(qq + coalesce(dd, 0) - 2 * coalesce(common, 0), 9) AS d
  FROM qn CROSS JOIN (SELECT doc_id FROM documents) d LEFT JOIN dn ON dn.doc_id = d.doc_id
  LEFT JOIN pairs p ON p.item_id = qn.item_id AND p.doc_id = d.doc_id)
SELECT query_id, rank, doc_id, round(1 - d, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS rank FROM found) WHERE rank <= {C.DEFAULT_SEARCH_K}""",
    "embed_new_entries": f"""WITH k AS (SELECT doc_id, {_KEY} AS key, text FROM documents)
SELECT key, arg_min(length(text), doc_id)::BIGINT AS text_length FROM k
WHERE key NOT IN (SELECT key FROM k WHERE doc_id IN (SELECT doc_id FROM labels))
GROUP BY key HAVING arg_min(length(text), doc_id) >= 5""",
}
ORACLE["indexed_topk"] = ORACLE["term_topk"]


def _ask_sql() -> str:
    from corpusloom.operators import prompts
    from corpusloom.plans.prompt_queries import _text
    from corpusloom.plans.split_sql import quoted

    return f"""WITH hits AS ({ORACLE["text_search"]}),
context AS (SELECT query_id, {quoted(prompts.CONTEXT_HEAD["openai"])} || string_agg(chr(10) || rank || '. From ''' || coalesce(source, 'Unknown') || ''':'
  || chr(10) || left(text, {prompts.CONTEXT_CHARS["openai"]}) || '...' || chr(10), '' ORDER BY rank) AS context
  FROM hits JOIN documents USING (doc_id) WHERE rank <= {C.CONTEXT_HITS} GROUP BY query_id)
SELECT item_id AS query_id, {_text(prompts.PROMPTS["openai"], context="coalesce(context, '')", question="('Question: ' || text)")} AS prompt
FROM benchmark LEFT JOIN context ON query_id = item_id"""


ORACLE["ask_prompts"] = _ask_sql()
