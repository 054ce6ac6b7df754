"""Registered queries over the chunk table: upsert, samples, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import upload_id
from corpusloom.operators import chunking, collection, store
from corpusloom.plans.tables import documents, table
from corpusloom.session import scratch_path

TECHNOLOGY = "CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'nodejs' WHEN 'de' THEN 'mongodb' END"


def _batch(spark, sf_dir):
    """Writes: every labelled document once or twice, and new rows from the benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    first = labelled.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("v1 "), "text").alias("content"), "source", F.lit(1).alias("seq")
    )
    second = labelled.where("quality = 1").select(
        F.col("doc_id").alias("id"), F.concat("text", F.lit(" v2")).alias("content"), "source", F.lit(2).alias("seq")
    )
    fresh = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 1000000000).alias("id"), F.col("text").alias("content"),
        F.lit("benchmark").alias("source"), F.lit(1).alias("seq"),
    )
    return first.unionByName(second).unionByName(fresh)


def upsert_latest(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "source"
    )
    out = store.upsert(old, store.cleaned(_batch(spark, sf_dir)))
    return out.select("id", F.md5("content").alias("digest"), "source")


def upsert_counts(spark, sf_dir):
    return store.rows_written(_batch(spark, sf_dir))


def _windows(spark, sf_dir):
    """(chunks of all documents, chunks of new and shorter versions of the labelled ones)."""
    docs = documents(spark, sf_dir, "doc_id")
    fresh = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").withColumn(
        "content", F.replace("content", F.lit(" "), F.lit(""))
    )

    def rows(frame):
        cut = chunking.fixed_windows(frame)
        return cut.select(
            upload_id(F.col("doc_id").cast("string"), "chunk_position").alias("id"), "doc_id", "chunk_id"
        )

    return rows(docs), rows(fresh).withColumn("seq", F.lit(1))


def upsert_replacing(spark, sf_dir):
    """New versions of labelled documents are shorter; their surplus old chunks go."""
    rows, new = _windows(spark, sf_dir)
    return store.upsert(rows, new, document_col="doc_id").select("id", "doc_id", "chunk_id")


def _stored(spark, sf_dir, **options):
    """A stored collection of all documents."""
    path = scratch_path(spark, "collection")
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "lang")
    collection.create(old, path, **options)
    return path


def stored_upsert(spark, sf_dir):
    """The same writes as in ``upsert_latest``, to a stored collection in place."""
    path = _stored(spark, sf_dir)
    collection.upsert(store.cleaned(_batch(spark, sf_dir)), path)
    return collection.read(spark, path).select("id", F.md5("content").alias("digest"), "source")


def stored_versions(spark, sf_dir):
    """A collection as it was before a write and after it: a reader may be at either."""
    path = _stored(spark, sf_dir)
    collection.upsert(_batch(spark, sf_dir), path)
    both = [collection.read(spark, path, v).withColumn("version", F.lit(v)) for v in collection.versions(spark, path)]
    rows = both[0].unionByName(both[1])
    return rows.groupBy("version", "source").agg(F.count("*").alias("rows"), F.sum(F.length("content")).alias("chars"))


def stored_layout(spark, sf_dir):
    """Buckets after toxic documents were written anew: those that hold none keep their files."""
    path = _stored(spark, sf_dir, buckets=256)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    new = collection.read(spark, path).join(toxic, "id", "left_semi").withColumn("content", F.lit("")).withColumn("seq", F.lit(1))
    collection.upsert(new, path)
    where = collection.layout(spark, path).withColumnRenamed("bucket", "_bucket")
    rows = collection.read(spark, path).withColumn("bucket", collection.bucket_of("id", 256))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("rows"))
    return counts.join(F.broadcast(where), F.col("bucket") == F.col("_bucket")).select("bucket", "version", "rows")


def stored_replacing(spark, sf_dir):
    """New and shorter versions of labelled documents, in a collection laid out by document."""
    path = scratch_path(spark, "collection")
    rows, new = _windows(spark, sf_dir)
    collection.create(rows, path, document_col="doc_id")
    collection.upsert(new, path, replace_document=True)
    return collection.read(spark, path).select("id", "doc_id", "chunk_id")


def merged_stats(spark, sf_dir):
    """Rows by source and by language after a write, merged from what each write has left; and
    whether the estimate of different ids is within a tenth of their number."""
    path = _stored(spark, sf_dir, stats_by=("source", "lang"))
    collection.upsert(_batch(spark, sf_dir), path)
    out = collection.stored_stats(spark, path)
    return out.select("of", "value", "rows", (F.abs(F.col("ids") - F.col("rows")) * 10 <= F.col("rows")).alias("close"))


def collection_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return store.sample_rows(docs, "doc_id")


def collection_stats(spark, sf_dir):
    return store.collection_stats(table(spark, sf_dir, "documents"), "doc_id")


def source_stats(spark, sf_dir):
    return store.source_counts(table(spark, sf_dir, "documents"))


def sample_source_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return store.source_counts(store.sample_rows(docs, "doc_id"))


def _by_technology(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", "text", F.expr(TECHNOLOGY).alias("technology")
    )


def technology_available(spark, sf_dir):
    return store.technology_available(_by_technology(spark, sf_dir), C.TECHNOLOGIES)


def technology_stats(spark, sf_dir):
    rows = _by_technology(spark, sf_dir).where(F.col("technology").isNotNull())
    out = store.technology_stats(rows, "doc_id", "text")
    return out.withColumn("sample_content", F.array_join("sample_content", "|"))


def corpus_status(spark, sf_dir):
    return store.corpus_status(_by_technology(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    upsert_latest, upsert_counts, upsert_replacing, stored_upsert, stored_versions, stored_layout, stored_replacing,
    merged_stats, collection_sample, collection_stats, source_stats,
    sample_source_stats, technology_available, technology_stats, corpus_status,
)}

_BATCH = """batch AS (
  SELECT d.doc_id AS id, 'v1 ' || text AS content, source, 1 AS seq FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT d.doc_id, text || ' v2', source, 2 FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1
  UNION ALL SELECT item_id + 1000000000, text, 'benchmark', 1 FROM benchmark)"""
_WIN = """SELECT doc_id, i, substring(md5(substring(txt, i * 800 + 1, 1000) || i::VARCHAR), 1, 16) AS chunk_id
FROM (SELECT doc_id, txt, unnest(range(greatest(0, length(txt) - 201) // 800 + 1)) AS i FROM {0} WHERE txt <> '')"""

ORACLE = {
    "upsert_latest": f"""WITH {_BATCH},
last AS (SELECT * FROM batch b WHERE seq = (SELECT max(seq) FROM batch c WHERE c.id = b.id))
SELECT coalesce(l.id, d.doc_id) AS id, md5(coalesce(l.content, d.text)) AS digest, coalesce(l.source, d.source) AS source
FROM documents d FULL JOIN last l ON d.doc_id = l.id""",
    "upsert_counts": f"WITH {_BATCH} SELECT count(*) AS offered, count(DISTINCT id) AS written FROM batch",
    "upsert_replacing": f"""WITH final AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN text ELSE replace(text, ' ', '') END AS txt
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'upload_' || doc_id || '_' || i AS id, doc_id, chunk_id FROM ({_WIN.format('final')})""",
    "collection_sample": "SELECT doc_id, source, lang FROM documents ORDER BY doc_id LIMIT 1000",
    "collection_stats": """WITH s AS (SELECT source FROM documents ORDER BY doc_id LIMIT 1000)
SELECT (SELECT count(*) FROM documents) AS total_chunks, count(*) AS sample_size, count(DISTINCT source) AS sample_sources FROM s""",
    "source_stats": "SELECT source, count(*) AS chunks FROM documents GROUP BY source",
    "sample_source_stats": "SELECT source, count(*) AS chunks FROM (SELECT source FROM documents ORDER BY doc_id LIMIT 1000) GROUP BY source",
    "technology_available": "SELECT key, name, EXISTS (SELECT 1 FROM documents WHERE " + TECHNOLOGY + """ = key) AS available
FROM (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in C.TECHNOLOGIES.items()) + ") t(key, name)",
    "technology_stats": f"""SELECT technology, count(*) AS total_chunks, least(count(*), 5) AS chunk_count,
  string_agg(left(text, 100), '|' ORDER BY doc_id) FILTER (n <= 5) AS sample_content
FROM (SELECT *, row_number() OVER (PARTITION BY technology ORDER BY doc_id) AS n
      FROM (SELECT doc_id, text, {TECHNOLOGY} AS technology FROM documents)) WHERE technology IS NOT NULL GROUP BY technology""",
    "corpus_status": f"""SELECT count(*) AS document_count, count(DISTINCT source) AS sources,
  count(DISTINCT {TECHNOLOGY}) AS technologies, {len(C.FORMATS)}::BIGINT AS formats FROM documents""",
}

_LAST = f"""WITH {_BATCH},
last AS (SELECT * FROM batch b WHERE seq = (SELECT max(seq) FROM batch c WHERE c.id = b.id)),
final AS (SELECT coalesce(l.id, d.doc_id) AS id, coalesce(l.content, d.text) AS content, coalesce(l.source, d.source) AS source,
  CASE WHEN l.id IS NULL THEN d.lang END AS lang FROM documents d FULL JOIN last l ON d.doc_id = l.id)"""
_BUCKET = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 256"

ORACLE |= {
    "stored_upsert": ORACLE["upsert_latest"],
    "stored_replacing": ORACLE["upsert_replacing"],
    "stored_versions": f"""{_LAST}
SELECT 1 AS version, source, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source
UNION ALL SELECT 2, source, count(*), sum(length(content))::BIGINT FROM final GROUP BY source""",
    "stored_layout": f"""SELECT ({_BUCKET})::INT AS bucket, CASE WHEN bool_or(coalesce(toxic, 0) = 1) THEN 2 ELSE 1 END AS version, count(*) AS rows
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "merged_stats": f"""{_LAST}
SELECT 'source' AS "of", source AS value, count(*) AS rows, true AS close FROM final GROUP BY source
UNION ALL SELECT 'lang', lang, count(*), true FROM final GROUP BY lang""",
}
