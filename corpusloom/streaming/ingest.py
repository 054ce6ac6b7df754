"""Incremental ingest: new documents are chunked and upserted as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom import constants as C
from corpusloom.functions.text import clean_text, upload_id
from corpusloom.operators import collection, store
from corpusloom.operators.chunking import chunk_documents
from corpusloom.operators.joins import small_side
from corpusloom.session import written
from corpusloom.sources import files as sources
from corpusloom.sources.files import extract
from corpusloom.streaming.sink import write_batches


def document_chunks(
    docs: DataFrame, name: str = "title", size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP
) -> DataFrame:
    """Chunk rows with their table id, ready for upsert; works on static and streaming frames."""
    chunks = chunk_documents(docs, size, overlap)
    return chunks.withColumn("id", upload_id(name, "chunk_position")).withColumn(
        "content", clean_text("content")
    )


def ingest_documents(docs: DataFrame, path: str, checkpoint: str, name: str = "title", **options) -> StreamingQuery:
    return write_batches(document_chunks(docs, name), path, checkpoint, **options)


def ingest_files(files: DataFrame, path: str, checkpoint: str, source: str = "api_upload", **options) -> StreamingQuery:
    """Uploaded files (a binaryFile stream): extracted, failures left out, chunked, upserted."""
    docs = extract(files).where("success").select(
        F.col("filename").alias("title"), "content", F.lit(source).alias("source"), "file_type"
    )
    return ingest_documents(docs, path, checkpoint, **options)


UPLOADS = "path string, modificationTime timestamp, length long, content binary"


def upload_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Files below a folder as they come in. A path is read once: a new version of a file comes
    under another path, such as a folder of its day, with the same file name."""
    stream = spark.readStream.format("binaryFile").schema(UPLOADS).option("recursiveFileLookup", True)
    return stream.option("maxFilesPerTrigger", files_per_batch).load(path)


def ingest_uploads(
    uploads: DataFrame, path: str, checkpoint: str, vectoriser: Callable[[DataFrame], DataFrame] | None = None,
    source: str = "api_upload", trigger: dict | None = None, buckets: int = collection.BUCKETS,
) -> StreamingQuery:
    """A stream of files (UPLOADS) into a stored collection, laid out by document (``title``).

    A document is known by its file name. A file that is stored already with the same content is
    left out before anything is extracted; a newer one replaces all that its document had; an older
    one changes nothing, whenever it arrives. The collection itself remembers content and time of
    what it has, so no state grows with the files, and a repeated batch finds its own work done.
    ``vectoriser`` adds further columns to the chunks. What became of each file of a batch is
    written to ``<path>-reports``: stored, known, older, superseded (within its batch), empty (no
    text: nothing changes), or the problem or error.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        given = sources.gate(batch).withColumns({
            "digest": F.sha2("content", 256), "made": F.col("modificationTime"), "title": sources.base_name(F.col("path")),
        })
        # Judged by names, times and digests; contents are read again for the files that are taken.
        narrow = written(given.drop("content", "length"), "uploads")
        gated = sources.latest_named(narrow.where("problem IS NULL")).unionByName(
            narrow.where("problem IS NOT NULL").withColumn("superseded", F.lit(False))
        )
        fresh = gated.where("problem IS NULL AND NOT superseded")
        if collection.versions(spark, path):
            held = collection.beside(fresh, path, "title").groupBy("title").agg(
                F.max_by("digest", "upload_timestamp").alias("_digest"), F.max("upload_timestamp").alias("_newest")
            )
        else:
            held = spark.createDataFrame([], "title string, _digest string, _newest timestamp")
        state = (
            F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("superseded"), "superseded")
            .when(F.col("digest") == F.col("_digest"), "known").when(F.col("made") < F.col("_newest"), "older")
        )
        judged = written(gated.join(held, "title", "left").withColumn("outcome", state).drop("_digest", "_newest"), "judged")
        taken, others = judged.where("outcome IS NULL"), judged.where("outcome IS NOT NULL")
        contents = given.drop("problem", "title")
        report = extract(_of_files(contents, taken, others))
        docs = report.where("success").select(
            F.col("filename").alias("title"), "content", "file_type", F.lit(source).alias("source"),
            F.col("made").alias("upload_timestamp"), "digest",
        )
        rows = document_chunks(docs).withColumn("seq", F.lit(0))
        rows = store.cleaned(vectoriser(rows) if vectoriser else rows)
        if not collection.versions(spark, path):
            collection.create(rows.drop("seq").limit(0), path, document_col="title", buckets=buckets)
        collection.upsert(rows, path, replace_document=True, version_col="upload_timestamp", tag=f"{checkpoint}:{number}")
        mine = ["title", "digest"]  # not known before, so what the collection has of it is of this batch
        chunks = collection.beside(taken, path, "title").groupBy(*mine).agg(F.count("*").alias("chunks"))
        done = written(taken.join(chunks, mine, "left"), "done")
        # Only files without a chunk are extracted again, for their errors.
        bare, full = done.where("chunks IS NULL"), done.where("chunks IS NOT NULL")
        failed = extract(_of_files(contents, bare, full.unionByName(others, allowMissingColumns=True))).select(
            F.lit(None).cast("long").alias("chunks"), F.col("filename").alias("title"), F.coalesce("error", F.lit("empty")).alias("outcome")
        )
        both = full.withColumn("outcome", F.lit("stored")).select("title", "outcome", "chunks").unionByName(failed, allowMissingColumns=True)
        both = both.unionByName(others.select("title", "outcome"), allowMissingColumns=True)
        both.write.mode("overwrite").parquet(f"{path}-reports/batch={number}")

    return (
        uploads.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
    )


def _of_files(contents: DataFrame, taken: DataFrame, others: DataFrame) -> DataFrame:
    """Files with contents that are among the taken ones; all others are given, too. The shorter list
    goes out to where the contents are, and none if there are no others."""
    few, how = (others, "left_anti") if others.count() <= taken.count() else (taken, "left_semi")
    keys = ("path", "made", "digest")
    side, count = small_side(few.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct(), "files")
    if not count:
        return contents if how == "left_anti" else contents.limit(0)
    same = [contents[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    return contents.join(side, same[0] & same[1] & same[2], how)


def upload_reports(spark: SparkSession, path: str) -> DataFrame:
    """batch, title, outcome and chunks of every file that has come in."""
    return spark.read.schema("title string, outcome string, chunks long, batch long").parquet(f"{path}-reports")
