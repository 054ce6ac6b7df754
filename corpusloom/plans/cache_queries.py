"""Registered cache queries. The event log is the access log; documents hold repeated texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.predicates import cacheable_response
from corpusloom.functions.text import embedding_key, response_key
from corpusloom.operators import caches
from corpusloom.plans.tables import table
from corpusloom.session import scratch_path, written

NOW = "2024-01-02 00:00:00"
TTL = 43200
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _embedding_cache(spark, sf_dir):
    """Entries for the texts of labelled documents, made at one a minute."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    made = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(entry % 1440 as int), 0)")
    return labelled.groupBy(embedding_key("text").alias("key")).agg(F.min("doc_id").alias("entry")).withColumn(
        "created_at", made
    )


def _lookups(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", embedding_key("text").alias("key"))


def embedding_cache_lookup(spark, sf_dir):
    found = caches.lookup(_lookups(spark, sf_dir), _embedding_cache(spark, sf_dir), "entry")
    return found.select("doc_id", "hit", "entry")


def bucketed_cache_lookup(spark, sf_dir):
    """The same lookups in a stored cache that was filled in two steps."""
    cache, path = _embedding_cache(spark, sf_dir), scratch_path(spark, "bucketed")
    early = F.col("entry") % 2 == 0
    caches.save_bucketed(cache.where(early), path, 16)
    stored = caches.save_bucketed(cache.where(~early), path, 16, "append")
    return caches.lookup_bucketed(_lookups(spark, sf_dir), stored, "entry", 16).select("doc_id", "hit", "entry")


def cache_lookup_ttl(spark, sf_dir):
    cache = _embedding_cache(spark, sf_dir)
    found = caches.lookup(_lookups(spark, sf_dir), cache, "entry", ttl_seconds=TTL, now=NOW)
    return found.select("doc_id", "hit", "entry")


def hit_rate(spark, sf_dir):
    found = caches.lookup(_lookups(spark, sf_dir), _embedding_cache(spark, sf_dir), "entry")
    return caches.hit_rate(found, ["lang"]).withColumn("hit_rate", F.round("hit_rate", 6))


def response_cache_lookup(spark, sf_dir):
    """Answers are stored under question and context; asked again in capitals they are found."""
    talk = table(spark, sf_dir, "conversations")
    asked = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = talk.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    pairs = asked.join(replies, ["conv_id", "turn"], "left")
    context = F.array_compact(F.array("reply"))
    cache = pairs.where(cacheable_response("reply")).select(
        response_key("question", context).alias("key"), F.col("reply").alias("response")
    ).groupBy("key").agg(F.min("response").alias("response"))
    again = pairs.withColumn("key", response_key(F.translate("question", LOWER, LOWER.upper()), context))
    return caches.lookup(again, cache, "response").select("conv_id", "turn", "hit", "response")


def _access_log(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props"), 256)
    return events.groupBy(key.alias("key")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("accessed_at"),
        F.max(F.length("props")).cast("bigint").alias("text_length"),
    )


def _stored_cache(spark, sf_dir):
    """A cache is a stored table: eviction reads it several times."""
    return written(_access_log(spark, sf_dir), "cache")


def lru_keep(spark, sf_dir):
    kept = caches.keep_recent(_stored_cache(spark, sf_dir), C.RESPONSE_CACHE_SIZE)
    return kept.select("key", "value", "accessed_at")


def bulk_evict(spark, sf_dir):
    left = caches.evict_oldest(_stored_cache(spark, sf_dir), C.RESPONSE_CACHE_SIZE)
    return left.select("key", "value", "accessed_at")


def cache_store(spark, sf_dir):
    """New entries from the labels: the cache keeps its limit, however many keys are new."""
    cache = _stored_cache(spark, sf_dir).select("key", "value", "created_at", "accessed_at")
    new = table(spark, sf_dir, "labels").select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("key"), F.col("quality").cast("double").alias("value"),
        F.expr("timestamp_ntz'2025-01-01 00:00:00'").alias("created_at"),
        F.expr("timestamp_ntz'2025-01-01 00:00:00'").alias("accessed_at"),
    )
    return caches.store(cache, new, C.RESPONSE_CACHE_SIZE).select("key", "value", "accessed_at")


def cache_touch(spark, sf_dir):
    """Entries as old as their making, refreshed by the clicks among the events."""
    cache = _stored_cache(spark, sf_dir).withColumn("accessed_at", F.col("created_at"))
    clicks = table(spark, sf_dir, "events").where("event_id % 2 = 0")
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props"), 256)
    out = caches.touch(cache, clicks.select(key.alias("key"), F.col("ts").alias("at")))
    return out.select("key", "created_at", "accessed_at")


def cache_stats(spark, sf_dir):
    out = caches.cache_stats(_access_log(spark, sf_dir), C.EMBEDDING_CACHE_SIZE, "key")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_text_length", "cache_size_mb")})


def cache_roundtrip(spark, sf_dir):
    cache = _access_log(spark, sf_dir)
    path = scratch_path(spark, "cache")
    caches.save(cache, path)
    return caches.load(spark, path, cache.schema)


def cache_clear(spark, sf_dir):
    cache = _access_log(spark, sf_dir)
    path = scratch_path(spark, "cache")
    caches.save(cache, path)
    caches.clear(cache, path)
    return caches.load(spark, path, cache.schema)


QUERIES = {f.__name__: f for f in (
    embedding_cache_lookup, bucketed_cache_lookup, cache_lookup_ttl, hit_rate, response_cache_lookup, lru_keep, bulk_evict,
    cache_store, cache_touch, cache_stats, cache_roundtrip, cache_clear,
)}

_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_CACHE = f"""cache AS (SELECT key, min(doc_id) AS entry FROM (
  SELECT d.doc_id, sha256('default:' || lower(trim(text, {_WS}))) AS key FROM documents d JOIN labels l ON d.doc_id = l.doc_id) GROUP BY key),
found AS (SELECT d.doc_id, d.lang, c.entry FROM (
  SELECT doc_id, lang, sha256('default:' || lower(trim(text, {_WS}))) AS key FROM documents) d LEFT JOIN {{0}} c ON d.key = c.key)"""
_LOG = """log AS (SELECT key, max_by(value, (ts, event_id)) AS value, min(ts) AS created_at, max(ts) AS accessed_at,
  max(length(props))::BIGINT AS text_length
  FROM (SELECT *, sha256(user_id || '|' || event_type || '|' || props) AS key FROM events) GROUP BY key)"""
_RESPONSE = f"sha256(trim(lower({{0}}), {_WS}) || '_' || CASE WHEN reply IS NULL THEN '' ELSE substring(sha256(substring(reply, 1, 200)), 1, 16) END)"

ORACLE = {
    "embedding_cache_lookup": f"WITH {_CACHE.format('cache')} SELECT doc_id, entry IS NOT NULL AS hit, entry FROM found",
    "cache_lookup_ttl": f"""WITH {_CACHE.format(f"(SELECT * FROM cache WHERE date_diff('second', TIMESTAMP '2024-01-01 00:00:00' + to_minutes(entry % 1440), TIMESTAMP '{NOW}') <= {TTL})")}
SELECT doc_id, entry IS NOT NULL AS hit, entry FROM found""",
    "hit_rate": f"""WITH {_CACHE.format('cache')} SELECT lang, count(*) AS lookups, count(entry) AS hits,
  round(100.0 * count(entry)::DOUBLE / count(*), 6) AS hit_rate FROM found GROUP BY lang""",
    "response_cache_lookup": f"""WITH pairs AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS reply
  FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user'),
cache AS (SELECT key, min(reply) AS response FROM (SELECT {_RESPONSE.format('question')} AS key, reply FROM pairs WHERE length(reply) >= 10) GROUP BY key)
SELECT conv_id, turn, response IS NOT NULL AS hit, response
FROM (SELECT conv_id, turn, {_RESPONSE.format(f"translate(question, '{LOWER}', '{LOWER.upper()}')")} AS key FROM pairs) p LEFT JOIN cache c ON p.key = c.key""",
    "lru_keep": f"""WITH {_LOG} SELECT key, value, accessed_at FROM (
  SELECT *, row_number() OVER (ORDER BY accessed_at DESC, key DESC) AS n FROM log) WHERE n <= {C.RESPONSE_CACHE_SIZE}""",
    "bulk_evict": f"""WITH {_LOG} SELECT key, value, accessed_at FROM (
  SELECT *, row_number() OVER (ORDER BY accessed_at, key) AS n, count(*) OVER () AS entries FROM log)
WHERE entries < {C.RESPONSE_CACHE_SIZE} OR n > greatest(1, entries // 10)""",
    "cache_store": f"""WITH {_LOG}, new AS (SELECT sha256(doc_id::VARCHAR) AS key, quality::DOUBLE AS value, TIMESTAMP '2025-01-01' AS accessed_at FROM labels),
sizes AS (SELECT (SELECT count(*) FROM log) AS old, (SELECT count(*) FROM new WHERE key NOT IN (SELECT key FROM log)) AS added),
left_over AS (SELECT CASE WHEN added <= greatest(0, {C.RESPONSE_CACHE_SIZE} - old) THEN old + added
  ELSE {C.RESPONSE_CACHE_SIZE} - {C.RESPONSE_CACHE_SIZE // 10} + 1
    + (added - greatest(0, {C.RESPONSE_CACHE_SIZE} - old) - 1) % {C.RESPONSE_CACHE_SIZE // 10} END AS n FROM sizes),
both_parts AS (SELECT key, value, accessed_at FROM log WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT * FROM new)
SELECT key, value, accessed_at FROM (SELECT *, row_number() OVER (ORDER BY accessed_at DESC, key DESC) AS place FROM both_parts)
WHERE place <= (SELECT n FROM left_over)""",
    "cache_touch": f"""WITH {_LOG}, used AS (SELECT sha256(user_id || '|' || event_type || '|' || props) AS key, max(ts) AS last
  FROM events WHERE event_id % 2 = 0 GROUP BY ALL)
SELECT l.key, created_at, greatest(created_at, coalesce(last, created_at)) AS accessed_at FROM log l LEFT JOIN used u ON l.key = u.key""",
    "cache_stats": f"""WITH {_LOG} SELECT count(*) AS total_entries, {C.EMBEDDING_CACHE_SIZE}::BIGINT AS max_size, min(created_at) AS oldest_entry,
  max(created_at) AS newest_entry, round(avg(text_length), 6) AS avg_text_length, round(sum(64) / 1048576.0::DOUBLE, 6) AS cache_size_mb FROM log""",
    "cache_roundtrip": f"WITH {_LOG} SELECT * FROM log",
    "cache_clear": f"WITH {_LOG} SELECT * FROM log WHERE false",
}

ORACLE["bucketed_cache_lookup"] = ORACLE["embedding_cache_lookup"]
