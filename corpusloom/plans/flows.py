"""End-to-end flows: questions to prompts, files to a searchable table, a corpus to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.operators import chunking, embedding, hits, prompts, search, store
from corpusloom.session import written
from corpusloom.sources import files


def search_texts(
    collection: DataFrame, questions: DataFrame, model: embedding.TermModel, k: int = C.DEFAULT_SEARCH_K,
    where: dict | None = None, id_col: str = "id", metric: str = "l2",
) -> DataFrame:
    """Hits for question texts (query_id, question) over embedded rows (id, embedding)."""
    asked = questions.where(P.query_problem("question").isNull()).select(
        "query_id", T.expand_query(T.normalise_query("question")).alias("text")
    )
    # Written: the search looks at the questions more than once, and each look would embed them.
    vectors = written(embedding.vectorise(asked, model, "query_vector").select("query_id", "query_vector"), "questions")
    return search.nearest(collection, vectors, k, metric, where, id_col)


def ask(
    collection: DataFrame, questions: DataFrame, model: embedding.TermModel, provider: str = "ollama",
    k: int = C.DEFAULT_SEARCH_K, technology: str | None = None, sources: list[str] | None = None,
    mode: str = "smart_answer", web: DataFrame | None = None, overlap: int = C.DEFAULT_K_OVERLAP,
) -> tuple[DataFrame, DataFrame]:
    """(prompts ready for batch inference, hits behind them) for a batch of questions.

    ``collection`` has id, title, content, embedding and the columns that filters name; ``web``
    holds raw web results, taken from the first provider that has any.
    """
    shown = collection.select("id", "title", "content")
    if mode == "web_only":
        kind = questions.schema["query_id"].dataType.simpleString()
        found = shown.sparkSession.createDataFrame(
            [], f"id string, title string, content string, query_id {kind}, rank bigint, score double"
        )
    else:
        spec = P.request_filter(technology, sources)
        found = search_texts(collection, questions, model, k + overlap, spec)
        found = search.with_content(found.select("query_id", "rank", "id", "score"), shown)
    if web is not None:
        from corpusloom.sources.web import web_hits

        extra = hits.first_provider(web_hits(web)).select("query_id", "rank", "title", "content", "score", "provider")
        found = hits.append_hits(found, extra)
    asked = questions.withColumn("question", prompts.mode_question(F.lit(mode), "question"))
    limit = C.CONTEXT_HITS
    context = prompts.context_blocks(found, provider, limit=limit)
    if mode == "code_generation":
        asked = asked.withColumn("question", prompts.code_prompt("question", F.lit("python")))
    return prompts.prompts(asked, context, provider), found


def ingest(
    raw_files: DataFrame, existing: DataFrame, model: embedding.TermModel, source: str = "api_upload",
    replace_document: bool = True, at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new collection, extraction report) after a batch of files.

    A document is known by its file name, as its ids are made of it. Of several files of one name
    the one changed last is stored (then the one whose path comes last); the report has
    ``superseded`` for the others. All files of the batch get one ``upload_timestamp``, the
    current time unless ``at`` is given. What a document had before is replaced.
    """
    rows, report = upload_chunks(raw_files, source, at)
    rows = embedding.vectorise(rows.withColumn("text", F.col("content")), model).drop("text")
    return store.upsert(existing, store.cleaned(rows), document_col="title" if replace_document else None), report


def upload_chunks(raw_files: DataFrame, source: str = "api_upload", at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks with their ids, extraction report) of a batch of files."""
    accepted = files.gate(raw_files).where("problem IS NULL").drop("problem")
    report = files.extract(files.latest_named(accepted))
    docs = report.where("success AND NOT superseded").select(
        F.col("filename").alias("title"), "content", "file_type", F.lit(source).alias("source"),
        (F.current_timestamp() if at is None else at).cast("timestamp").alias("upload_timestamp"),
    )
    rows = chunking.chunk_documents(docs)
    return rows.withColumn("id", T.upload_id("title", "chunk_position")).withColumn("seq", F.lit(0)), report


def chunk_corpus(paths: list[str], spark, out: str | None = None) -> DataFrame:
    """Scraped document files to chunks, saved with their statistics when a path is given."""
    chunks = chunking.chunk_documents(files.read_scraped(spark, paths))
    if out:
        files.save_chunks(chunks, out)
        return files.load_chunks(spark, out, chunks.schema)
    return chunks
