"""Registered streaming queries: the tables are read as streams until nothing is left, and the
resulting tables are the results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.operators import collection
from corpusloom.plans.metric_queries import DAY_LIMITS
from corpusloom.plans.tables import table
from corpusloom.session import scratch_path, written
from corpusloom.streaming import ingest, monitor, sink


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/{name}.parque[t]")


def _run(spark, stream, keys, mode="update"):
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "state")
    sink.write_batches(stream, path, checkpoint, mode).awaitTermination()
    return sink.read_latest(spark, path, stream.schema, keys)


def _events(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 100)
    # A stored table: its files come in no order of time, so no row may count as late.
    return monitor.timed(events.withColumnRenamed("event_type", "endpoint"), late=None)


def stream_hourly_counts(spark, sf_dir):
    counts = monitor.windowed_counts(_events(spark, sf_dir), ["endpoint"])
    return _run(spark, counts, ["window_start", "endpoint"])


def stream_latency(spark, sf_dir):
    latency = monitor.windowed_latency(_events(spark, sf_dir), ["endpoint"], "seconds", "1 day")
    return _run(spark, latency, ["window_start", "endpoint"]).withColumn("sum", F.round("sum", 4))


def stream_rate_breaches(spark, sf_dir):
    found = monitor.breaches(_events(spark, sf_dir), "user_id", "endpoint", DAY_LIMITS, "1 day")
    return _run(spark, found, ["window_start", "user_id", "endpoint"])


PIECES = 4  # the events arrive in so many pieces
DELAYED = "purchase"  # and those of this type one piece late
LATE = "2 days"


def _in_pieces(spark, sf_dir, run, delayed=None):
    """Events arrive piece by piece, by equal spans of their time. After each piece the streams are
    started again from their checkpoints and take in what is new."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "endpoint")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    piece = F.floor(F.lit(PIECES) * (micros - F.lit(low)) / F.lit(high - low + 1))
    late = F.when(F.col("endpoint") == F.lit(delayed), 1).otherwise(0)
    events = written(events.withColumn("_piece", F.least(piece + late, F.lit(PIECES - 1)).cast("int")), "events")
    inbox = scratch_path(spark, "inbox")
    for i in range(PIECES):
        events.where(F.col("_piece") == i).drop("_piece").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.drop("_piece").schema).parquet(inbox)
        for query in run(stream):
            query.awaitTermination()


def stream_alerts(spark, sf_dir):
    """Clients over their limit, told once for each window, over four restarts."""
    path, checkpoint = scratch_path(spark, "alerts"), scratch_path(spark, "state")
    schema = []

    def run(stream):
        alerts = monitor.breach_alerts(stream, "user_id", "endpoint", DAY_LIMITS, LATE, "1 day")
        schema[:] = [alerts.schema]
        return [sink.write_batches(alerts, path, checkpoint, "append")]

    _in_pieces(spark, sf_dir, run)
    return spark.read.schema(schema[0]).parquet(path).drop("batch")


def _final(spark, sf_dir):
    path, checkpoint = scratch_path(spark, "final"), scratch_path(spark, "state")
    _in_pieces(spark, sf_dir, lambda s: monitor.write_final(s, ["endpoint"], LATE, path, checkpoint), DELAYED)
    return path, table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint")).schema


def stream_final_counts(spark, sf_dir):
    """Hourly counts of windows that can't change any more; one type of event comes late."""
    return monitor.final_counts(spark, *_final(spark, sf_dir))


def stream_late_counts(spark, sf_dir):
    """What came too late for its window."""
    path, labels = _final(spark, sf_dir)
    return monitor.late_counts(spark, path, labels, LATE)


def _uploads(spark, sf_dir):
    """Three rounds of files: every document; labelled ones once more, the toxic ones changed; and
    what these had been, arriving late."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    labelled = docs.join(toxic, "doc_id")
    changed = F.when(F.col("toxic"), F.concat(F.lit("changed "), "text")).otherwise(F.col("text"))
    rounds = [
        (docs, "2024-01-02"), (labelled.withColumn("text", changed), "2024-01-03"), (labelled.where("toxic"), "2024-01-01"),
    ]
    for i, (rows, day) in enumerate(rounds):
        name = F.concat(F.lit(f"/in/{i}/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        content = F.col("text").cast("binary")
        yield rows.select(
            name.alias("path"), F.lit(day).cast("timestamp").alias("modificationTime"),
            F.octet_length(content).cast("long").alias("length"), content.alias("content"),
        )


def _uploaded(spark, sf_dir):
    path, checkpoint, inbox = (scratch_path(spark, n) for n in ("uploaded", "state", "inbox"))
    for files in _uploads(spark, sf_dir):
        files.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(ingest.UPLOADS).parquet(inbox)
        ingest.ingest_uploads(stream, path, checkpoint).awaitTermination()
    return path


def stream_uploads(spark, sf_dir):
    """Files arrive in three rounds, with repeats and versions out of order, and end up as the
    chunks of the newest version of each."""
    rows = collection.read(spark, _uploaded(spark, sf_dir))
    return rows.select("id", "chunk_position", "total_chunks", "chunk_id", "content")


def stream_upload_outcomes(spark, sf_dir):
    """What became of the files of each round."""
    reports = ingest.upload_reports(spark, _uploaded(spark, sf_dir))
    return reports.groupBy("batch", "outcome").agg(F.count("*").alias("files"))


def stream_ingest(spark, sf_dir):
    """Documents arrive as a stream and end up as chunks in a table."""
    docs = _stream(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"), "doc_id", "source", F.col("text").alias("content")
    )
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "state")
    chunks = ingest.document_chunks(docs)
    ingest.ingest_documents(docs, path, checkpoint).awaitTermination()
    out = sink.read_documents(spark, path, chunks.schema, "title")
    return out.select("id", "doc_id", "source", "chunk_position", "total_chunks", "chunk_id", "content")


QUERIES = {f.__name__: f for f in (
    stream_hourly_counts, stream_latency, stream_rate_breaches, stream_alerts, stream_final_counts, stream_late_counts,
    stream_ingest, stream_uploads, stream_upload_outcomes,
)}


def _ingest_sql() -> str:
    from corpusloom.plans.chunk_queries import RECURSIVE
    from corpusloom.plans.split_sql import chunk_select

    return RECURSIVE + f"""SELECT 'upload_doc_' || doc_id || '_' || chunk_position AS id, doc_id, source, chunk_position, total_chunks, chunk_id, content
FROM ({chunk_select('plain')})"""


def _uploads_sql() -> str:
    """The splitter's twin over the newest versions."""
    from corpusloom.plans.chunk_queries import OVERLAP, SIZE
    from corpusloom.plans.split_sql import chunk_select, split_ctes

    return f"""WITH RECURSIVE toxic AS (SELECT doc_id AS id FROM labels GROUP BY doc_id HAVING max(toxic) = 1),
newest AS (SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT id FROM toxic) THEN 'changed ' || text ELSE text END AS txt FROM documents),
{split_ctes("newest", "cut", SIZE, OVERLAP, C.TEXT_SEPARATORS)},
pieces AS (SELECT id AS doc_id, 's' AS source, 0 AS seg, start, 'text' AS kind, content AS piece FROM cut)
SELECT 'upload_doc_' || doc_id || '.txt_' || chunk_position AS id, chunk_position, total_chunks, chunk_id, content
FROM ({chunk_select('pieces')})"""


_ALLOWED = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DAY_LIMITS.items()) + " END"
_BUCKETS = ", ".join(
    f"count(*) FILTER (value / 100 <= {b}) AS " + f"le_{b}".replace(".", "_")
    for b in (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
)

# A row is too late if its window ends no later than the newest time of all earlier pieces less LATE.
_PIECES = f"""WITH span AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events),
arriving AS (
  SELECT ts, event_type AS endpoint, date_trunc('hour', ts)::TIMESTAMP AS window_start,
    least({PIECES - 1}, {PIECES} * (epoch_us(ts) - low) // (high - low + 1) + CASE WHEN event_type = '{DELAYED}' THEN 1 ELSE 0 END) AS piece
  FROM events, span),
newest AS (SELECT piece, max(ts) AS newest FROM arriving GROUP BY piece),
judged AS (
  SELECT a.*, coalesce(window_start + INTERVAL 1 hour <= (SELECT max(newest) FROM newest n WHERE n.piece < a.piece) - INTERVAL {LATE}, false) AS late
  FROM arriving a),
closed AS (SELECT max(ts) - INTERVAL {LATE} AS until FROM events)"""

ORACLE = {
    "stream_alerts": f"""SELECT window_start, user_id, endpoint, allowed FROM (
  SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id, event_type AS endpoint, count(*) AS calls, any_value({_ALLOWED})::BIGINT AS allowed
  FROM events GROUP BY ALL) WHERE calls > allowed""",
    "stream_final_counts": f"""{_PIECES}
SELECT window_start, endpoint, count(*) AS total FROM judged, closed
WHERE NOT late AND window_start + INTERVAL 1 hour <= until GROUP BY ALL""",
    "stream_late_counts": f"{_PIECES} SELECT window_start, endpoint, count(*) AS late FROM judged WHERE late GROUP BY ALL",
    "stream_hourly_counts": "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type AS endpoint, count(*) AS total FROM events GROUP BY ALL",
    "stream_latency": f"""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS endpoint, {_BUCKETS},
  count(*) AS "count", round(sum(value / 100), 4) AS "sum" FROM events GROUP BY ALL""",
    "stream_rate_breaches": f"""SELECT * FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id, event_type AS endpoint, count(*) AS calls,
  any_value({_ALLOWED})::BIGINT AS allowed FROM events GROUP BY ALL) WHERE calls > allowed""",
    "stream_ingest": _ingest_sql(),
    "stream_uploads": _uploads_sql(),
    "stream_upload_outcomes": """WITH l AS (SELECT doc_id, max(toxic) = 1 AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT 0::BIGINT AS batch, 'stored' AS outcome, count(*) AS files FROM documents
UNION ALL SELECT 1, CASE WHEN toxic THEN 'stored' ELSE 'known' END, count(*) FROM l GROUP BY ALL
UNION ALL SELECT 2, 'older', count(*) FROM l WHERE toxic HAVING count(*) > 0""",
}
