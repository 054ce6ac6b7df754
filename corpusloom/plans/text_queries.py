"""Registered queries over scalar projections, filters and request checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.operators import stats
from corpusloom.plans.split_sql import SPACE, WORDS
from corpusloom.plans.tables import documents, pages, table

# Request parameters spread over valid and invalid values, from columns of the events.
K_ASKED = "CAST(CAST(floor({v}) AS BIGINT) % 130 AS BIGINT)"
TEMPERATURE = "{v} / 100"
TOKENS = "CAST(floor({v} * 20) AS BIGINT)"
# Questions: benchmark texts, with blank, very long, padded and short ones among them.
QUESTION = (
    "CASE WHEN item_id % 5 = 0 THEN concat('  ', {t}, chr(10), ' ') WHEN item_id % 5 = 1 THEN repeat({t}, 6) "
    "WHEN item_id % 5 = 2 THEN concat(chr(9), ' ') WHEN item_id % 5 = 3 THEN split_part({t}, ' ', 1) ELSE {t} END"
)
ROUTED = (
    "CASE WHEN doc_id % 4 = 0 THEN concat({t}, ' Python tutorial') WHEN doc_id % 4 = 1 THEN concat({t}, ' Django') ELSE {t} END"
)
ANSWER = "CASE WHEN turn % 2 = 0 THEN concat({t}, chr(10), '```sql', chr(10), 'select 1', chr(10), '```') ELSE {t} END"


def clean_text(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id")
    dirty = docs.withColumn("content", F.concat(F.lit("\x00 \n"), "content", F.lit("\x00\t ")))
    clean = T.clean_text("content")
    return dirty.select(
        "doc_id",
        F.md5(clean).alias("digest"),
        F.length(clean).cast("bigint").alias("n_chars"),
        F.length(T.strip(clean)).cast("bigint").alias("stripped_chars"),
        T.word_count(clean).alias("words"),
    )


def clean_metadata(spark, sf_dir):
    """Labels are missing for many documents: null metadata becomes empty text."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    meta = F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("quality"), F.col("quality").cast("string")
    )
    clean = T.clean_metadata(meta)
    return joined.select(
        "doc_id",
        T.field(clean, "quality", "absent").alias("quality"),
        T.field(clean, "title", "Unknown").alias("title"),
        T.field(clean, "lang", "unknown").alias("lang"),
        T.clean_field("toxic").alias("toxic"),
    )


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.expr(QUESTION.format(t="text")).alias("question")
    )


def query_validate(spark, sf_dir):
    problem = P.query_problem("question")
    return _questions(spark, sf_dir).select(
        "item_id",
        problem.alias("problem"),
        F.when(problem.isNull(), T.normalise_query("question")).alias("question"),
    )


def query_expand(spark, sf_dir):
    return _questions(spark, sf_dir).select("item_id", T.expand_query("question").alias("question"))


def request_checks(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(
        "event_id",
        *[F.expr(e.format(v="value")).alias(n) for n, e in
          (("k", K_ASKED), ("temperature", TEMPERATURE), ("max_tokens", TOKENS))],
    )
    return asked.select(
        "event_id",
        P.k_problem("k").alias("k_problem"),
        P.temperature_problem("temperature").alias("temperature_problem"),
        P.max_tokens_problem("max_tokens").alias("max_tokens_problem"),
        P.clamp_k("k").alias("k_used"),
    )


def topic_route(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id").withColumn("content", F.expr(ROUTED.format(t="content")))
    return docs.select("doc_id", T.topic("content").alias("topic"))


def chunk_ids(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id")
    return docs.select(
        "doc_id",
        T.chunk_id("content", "doc_id").alias("chunk_id"),
        T.upload_id(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")), "doc_id").alias("upload_id"),
    )


def cache_keys(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id")
    return docs.select(
        "doc_id",
        T.embedding_key("content", "all").alias("embedding_key"),
        T.response_key("content", F.array("content", F.reverse("content"))).alias("response_key"),
        T.response_key("content", F.array().cast("array<string>")).alias("response_key_no_hits"),
        P.cacheable_text("content").alias("cacheable"),
    )


def safe_filename(spark, sf_dir):
    """File names from page addresses."""
    name = T.safe_filename("url")
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"))


def file_extensions(spark, sf_dir):
    address = F.regexp_replace("url", "[?#].*", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.file_extension(F.concat(address, F.lit(".PDF"))).alias("suffix"),
        T.file_extension(T.base_name(address)).alias("own_suffix"),
    )


def previews(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id")
    return docs.select(
        "doc_id", *[T.preview("content", n).alias(f"first_{n}") for n in (50, 100, 200, 500, 800, 1000, 2000)]
    )


def fenced_answers(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    answer = F.expr(ANSWER.format(t="text"))
    return talk.select("conv_id", "turn", T.fenced_answer(answer).alias("answer"))


def epoch_times(spark, sf_dir):
    seconds = T.epoch_seconds("ts")
    back = F.unix_micros(T.from_epoch(seconds))
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(seconds, 6).alias("seconds"), F.round(back / 1e6, 3).alias("back")
    )


def technology_names(spark, sf_dir):
    """Language codes stand for keys; some are known technologies, others are not."""
    key = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "fr", "nodejs").otherwise(F.col("lang"))
    docs = table(spark, sf_dir, "documents").select("doc_id", key.alias("technology"))
    return docs.select(
        "doc_id", T.technology_name("technology").alias("name"),
        T.technology_name("technology", None).alias("name_or_null"),
    )


def metadata_filter(spark, sf_dir):
    spec = {"$and": [{"lang": "en"}, {"source": {"$in": ["src1", "src7", "src11"]}}, {"quality": 1}]}
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return P.apply_filter(joined, spec).select("doc_id", "lang", "source", "quality")


def not_blank(spark, sf_dir):
    """Lines that are not blank, over all documents."""
    lines = documents(spark, sf_dir, "doc_id").select("doc_id", F.explode(F.split("content", "\n")).alias("line"))
    return lines.where(P.not_blank("line")).groupBy("doc_id").agg(F.count("*").alias("lines"))


def batch_sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = stats.batch_sizes(docs, "source", "doc_id", "text")
    return out.withColumn("mean_length", F.round("mean_length", 6))


QUERIES = {f.__name__: f for f in (
    clean_text, clean_metadata, query_validate, query_expand, request_checks, topic_route, chunk_ids,
    cache_keys, safe_filename, file_extensions, previews, fenced_answers, epoch_times,
    technology_names, metadata_filter, not_blank, batch_sizes,
)}

_Q = f"(SELECT item_id, {QUESTION.format(t='text')} AS question FROM benchmark)"
_NORMAL = f"trim(regexp_replace(question, '\\s+', ' ', 'g'), {SPACE})"


def _contains_any(words) -> str:
    return " OR ".join(f"contains(lower(t), '{w}')" for w in words)


_KEY = "sha256(trim(lower(text), {0}) || '_' || {1})".format(SPACE, "{0}")
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.TECHNOLOGIES.items())

ORACLE = {
    "clean_text": f"""SELECT doc_id, md5(c) AS digest, length(c)::BIGINT AS n_chars,
  length(trim(c, {SPACE}))::BIGINT AS stripped_chars, {WORDS.format('c')}::BIGINT AS words
FROM (SELECT doc_id, replace(chr(0) || ' ' || chr(10) || text || chr(0) || chr(9) || ' ', chr(0), '') AS c FROM documents)""",
    "clean_metadata": """SELECT d.doc_id, coalesce(quality::VARCHAR, '') AS quality, 'Unknown' AS title, lang,
  coalesce(toxic::VARCHAR, '') AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "query_validate": f"""SELECT item_id, problem, CASE WHEN problem IS NULL THEN {_NORMAL} END AS question
FROM (SELECT *, CASE WHEN length(trim(question, {SPACE})) < 1 THEN 'too_short' WHEN length(question) > 1000 THEN 'too_long' END AS problem FROM {_Q})""",
    "query_expand": f"""SELECT item_id, CASE WHEN {WORDS.format('question')} < 3
  THEN question || ' documentation reference' ELSE question END AS question FROM {_Q}""",
    "request_checks": f"""SELECT event_id,
  CASE WHEN k < 1 THEN 'too_small' WHEN k > 100 THEN 'too_large' END AS k_problem,
  CASE WHEN t < 0 THEN 'too_small' WHEN t > 1 THEN 'too_large' END AS temperature_problem,
  CASE WHEN m < 100 THEN 'too_small' WHEN m > 4000 THEN 'too_large' END AS max_tokens_problem,
  least(k + 2, 100) AS k_used
FROM (SELECT event_id, {K_ASKED.format(v='value')} AS k, {TEMPERATURE.format(v='value')} AS t, {TOKENS.format(v='value')} AS m FROM events)""",
    "topic_route": f"""SELECT doc_id, CASE WHEN {_contains_any(C.TOPIC_WORDS['python'])} THEN 'python'
  WHEN {_contains_any(C.TOPIC_WORDS['web'])} THEN 'web' ELSE 'general' END AS topic
FROM (SELECT doc_id, {ROUTED.format(t='text')} AS t FROM documents)""",
    "chunk_ids": """SELECT doc_id, substring(md5(text || doc_id::VARCHAR), 1, 16) AS chunk_id,
  'upload_f' || doc_id || '.txt_' || doc_id AS upload_id FROM documents""",
    "cache_keys": f"""SELECT doc_id, sha256('all:' || lower(trim(text, {SPACE}))) AS embedding_key,
  {_KEY.format("substring(sha256(substring(text, 1, 200) || substring(reverse(text), 1, 200)), 1, 16)")} AS response_key,
  {_KEY.format("''")} AS response_key_no_hits, length(text) >= 5 AS cacheable FROM documents""",
    "safe_filename": """SELECT page_id, CASE WHEN n <> '' AND NOT starts_with(n, '.') THEN n END AS name
FROM (SELECT page_id, regexp_replace(list_extract(string_split(rtrim(url, '/'), '/'), -1), '[<>:"/\\\\|?*]', '_', 'g') AS n FROM pages)""",
    "file_extensions": """SELECT page_id, CASE WHEN n = '' THEN '' ELSE '.pdf' END AS suffix, CASE WHEN strpos(n, '.') > 1
  THEN '.' || lower(list_extract(string_split(n, '.'), -1)) ELSE '' END AS own_suffix
FROM (SELECT page_id, list_extract(string_split(regexp_replace(url, '[?#].*', ''), '/'), -1) AS n FROM pages)""",
    "previews": "SELECT doc_id, " + ", ".join(
        f"left(text, {n}) AS first_{n}" for n in (50, 100, 200, 500, 800, 1000, 2000)) + " FROM documents",
    "fenced_answers": f"""SELECT conv_id, turn, CASE WHEN strpos(a, '```') > 0 THEN a
  ELSE '```python' || chr(10) || a || chr(10) || '```' END AS answer
FROM (SELECT conv_id, turn, {ANSWER.format(t='text')} AS a FROM conversations WHERE role = 'assistant')""",
    "epoch_times": "SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS seconds, round(epoch_us(ts) / 1e6, 3) AS back FROM events",
    "technology_names": f"""SELECT doc_id, coalesce(n, 'General') AS name, n AS name_or_null
FROM (SELECT doc_id, CASE k {_NAMES} END AS n FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'nodejs' ELSE lang END AS k FROM documents))""",
    "metadata_filter": """SELECT d.doc_id, lang, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE lang = 'en' AND source IN ('src1', 'src7', 'src11') AND quality = 1""",
    "not_blank": f"""SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE trim(line, {SPACE}) <> '' GROUP BY doc_id""",
    "batch_sizes": """SELECT source, round(m, 6) AS mean_length,
  CASE WHEN m < 500 THEN 200 WHEN m < 2000 THEN 100 WHEN m < 5000 THEN 50 ELSE 25 END::BIGINT AS batch_size
FROM (SELECT source, avg(length(text)) AS m FROM (
  SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 100 GROUP BY source)""",
}
