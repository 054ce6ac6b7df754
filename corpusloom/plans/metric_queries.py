"""Registered queries over the request log: the events stand for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.operators import stats
from corpusloom.plans.tables import table

# Calls per client and day that are allowed here: the log is sparse, so the limits are low.
DAY_LIMITS = {"click": 2, "view": 2, "signup": 1, "purchase": 2, "error": 1}


def requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "value",
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type").isin("view", "click"), "GET").otherwise("POST").alias("method"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        (F.col("value") / 100).alias("seconds"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def counters(spark, sf_dir):
    return stats.counters(requests(spark, sf_dir), ["endpoint", "method", "status"])


def latency_histogram(spark, sf_dir):
    out = stats.latency_histogram(requests(spark, sf_dir), ["endpoint", "method"], "seconds")
    return out.withColumn("sum", F.round("sum", 4))


def token_totals(spark, sf_dir):
    used = requests(spark, sf_dir).withColumn("completion", F.floor("value").cast("bigint"))
    return stats.token_totals(used, "endpoint", "k", "completion")


def gauge_latest(spark, sf_dir):
    return stats.gauges(requests(spark, sf_dir), ["endpoint"], "value", "ts", "event_id")


def rate_limit_breaches(spark, sf_dir):
    return stats.rate_breaches(requests(spark, sf_dir), "user_id", "endpoint", "ts", DAY_LIMITS, "day")


def rate_limits_by_minute(spark, sf_dir):
    """A tenth of the default limits per minute, all users of an endpoint taken as one client."""
    kinds = F.when(F.col("endpoint") == "click", "search").when(F.col("endpoint") == "error", "upload").otherwise("query")
    calls = requests(spark, sf_dir).select(kinds.alias("endpoint"), "ts", F.lit("all").alias("client"))
    low = {k: v // 10 for k, v in C.RATE_LIMITS.items()}
    return stats.rate_breaches(calls, "client", "endpoint", "ts", low)


def error_counts(spark, sf_dir):
    ok = requests(spark, sf_dir).withColumn("success", F.col("status") == "200")
    return stats.ingest_summary(ok, by=["method"])


QUERIES = {f.__name__: f for f in (
    counters, latency_histogram, token_totals, gauge_latest, rate_limit_breaches, rate_limits_by_minute, error_counts,
)}

REQ = """req AS (SELECT event_id, ts, user_id, value, event_type AS endpoint,
  CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS method,
  CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, value / 100 AS seconds,
  json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""
_LES = ", ".join(f"({b!r}, '{b}')" for b in C.LATENCY_BUCKETS) + ", ('inf'::DOUBLE, '+Inf')"
_ALLOWED = "CASE endpoint " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DAY_LIMITS.items()) + " END"
_LOW = "CASE endpoint " + " ".join(f"WHEN '{k}' THEN {v // 10}" for k, v in C.RATE_LIMITS.items()) + " END"

ORACLE = {
    "counters": f"WITH {REQ} SELECT endpoint, method, status, count(*) AS total FROM req GROUP BY ALL",
    "latency_histogram": f"""WITH {REQ}, les(b, le) AS (VALUES {_LES}),
g AS (SELECT endpoint, method, count(*) AS "count", round(sum(seconds), 4) AS "sum" FROM req GROUP BY ALL),
n AS (SELECT endpoint, method, le, count(*) AS bucket_count FROM req JOIN les ON seconds <= b GROUP BY ALL)
SELECT g.endpoint, g.method, les.le, coalesce(bucket_count, 0) AS bucket_count, "count", "sum"
FROM g CROSS JOIN les LEFT JOIN n ON n.endpoint = g.endpoint AND n.method = g.method AND n.le = les.le""",
    "token_totals": f"""WITH {REQ} SELECT endpoint, 'prompt' AS token_type, sum(k)::BIGINT AS tokens FROM req GROUP BY endpoint
UNION ALL SELECT endpoint, 'completion', sum(floor(value)::BIGINT)::BIGINT FROM req GROUP BY endpoint""",
    "gauge_latest": f"""WITH {REQ} SELECT endpoint, value FROM (
  SELECT endpoint, value, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) AS n FROM req) WHERE n = 1""",
    "rate_limit_breaches": f"""WITH {REQ}, c AS (SELECT user_id, endpoint, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS calls FROM req GROUP BY ALL)
SELECT *, ({_ALLOWED})::BIGINT AS allowed FROM c WHERE calls > {_ALLOWED}""",
    "rate_limits_by_minute": f"""WITH {REQ}, c AS (SELECT 'all' AS client, CASE endpoint WHEN 'click' THEN 'search' WHEN 'error' THEN 'upload' ELSE 'query' END AS endpoint,
  date_trunc('minute', ts)::TIMESTAMP AS window_start FROM req),
n AS (SELECT client, endpoint, window_start, count(*) AS calls FROM c GROUP BY ALL)
SELECT *, ({_LOW})::BIGINT AS allowed FROM n WHERE calls > {_LOW}""",
    "error_counts": f"""WITH {REQ} SELECT method, count(*) AS documents, count(*) FILTER (status = '200') AS succeeded,
  count(*) FILTER (status <> '200') AS failed FROM req GROUP BY method""",
}
