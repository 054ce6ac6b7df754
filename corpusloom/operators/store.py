"""The chunk table: upsert, scans of it, and statistics over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import clean_metadata, clean_text, preview
from corpusloom.operators import joins
from corpusloom.operators.joins import latest_per_key, small_side
from corpusloom.session import scratch_path, written


def cleaned(rows: DataFrame, text_col: str = "content", metadata: str = "metadata") -> DataFrame:
    rows = rows.withColumn(text_col, clean_text(text_col))
    if metadata in rows.columns:
        rows = rows.withColumn(metadata, clean_metadata(metadata))
    return rows


def upsert(
    existing: DataFrame,
    new: DataFrame,
    id_col: str = "id",
    seq_col: str | None = "seq",
    document_col: str | None = None,
) -> DataFrame:
    """Rows of ``existing`` replaced and extended by ``new``, unique by id; the last write of an
    id within the batch wins (without ``seq_col`` no id comes twice). With ``document_col`` the rows a document had before are dropped
    first, so that a shorter new version leaves none behind."""
    last = latest_per_key(new, id_col, seq_col).drop(seq_col) if seq_col else new
    names = [id_col, document_col] if document_col else [id_col]
    keys, count = small_side(new.select(*names).distinct(), "upsert-keys")
    kept = existing
    for name in reversed(names):
        side = keys.select(name).distinct()
        kept = kept.join(F.broadcast(side) if count <= joins.SMALL_ROWS else side, name, "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def written_batch(new: DataFrame) -> DataFrame:
    """A batch of writes, kept so that deciding on it and applying it see the same rows."""
    return written(new, "batch")


def rows_written(new: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows offered and rows that end up in the table."""
    return new.agg(
        F.count("*").alias("offered"), F.count_distinct(id_col).alias("written")
    )


def write_collection(rows: DataFrame, label: str = "chunks", by: list[str] | None = None) -> str:
    """Write a chunk table to a fresh path and return it: readers move over when they choose.

    Partitioned by a column that filters name, a search reads only what its filter allows; a
    value with very many rows is split over tasks and files.
    """
    path = scratch_path(rows.sparkSession, label)
    writer = rows.hint("rebalance", *by).write.partitionBy(*by) if by else rows.write
    writer.parquet(path)
    return path


def sample_rows(rows: DataFrame, id_col: str = "id", limit: int = C.STATS_SAMPLE_LIMIT) -> DataFrame:
    """The sample that collection statistics look at, by id, so that it is always the same."""
    return rows.orderBy(id_col).limit(limit)


def collection_stats(rows: DataFrame, id_col: str = "id", source_col: str = "source") -> DataFrame:
    """One row: total rows, size of the sample, distinct sources in it."""
    total = rows.agg(F.count("*")).scalar().alias("total_chunks")
    sample = sample_rows(rows.select(id_col, source_col), id_col).agg(
        F.count("*").alias("sample_size"), F.count_distinct(source_col).alias("sample_sources")
    )
    return sample.select("*", total)


def source_counts(rows: DataFrame, source_col: str = "source") -> DataFrame:
    """Rows per source; rows without one are left out."""
    known = rows.where(F.col(source_col).isNotNull())
    return known.groupBy(source_col).agg(F.count("*").alias("chunks"))


def technology_available(
    rows: DataFrame, technologies: dict[str, str], technology_col: str = "technology"
) -> DataFrame:
    """Every known technology and whether the collection has a row of it."""
    known = rows.sparkSession.createDataFrame(list(technologies.items()), "key string, name string")
    present = rows.where(F.col(technology_col).isin(*technologies)).select(
        F.col(technology_col).alias("key")
    ).distinct().withColumn("available", F.lit(True))
    joined = known.join(F.broadcast(present), "key", "left")
    return joined.withColumn("available", F.coalesce("available", F.lit(False)))


def technology_stats(
    rows: DataFrame, id_col: str = "id", text_col: str = "content",
    technology_col: str = "technology", shown: int = 5, chars: int = 100,
) -> DataFrame:
    """Per technology: rows in all, rows shown, and the head of each row shown."""
    counts = rows.groupBy(technology_col).agg(F.count("*").alias("total_chunks"))
    w = Window.partitionBy(technology_col).orderBy(id_col)
    first = rows.select(technology_col, id_col, preview(text_col, chars).alias("_head"))
    first = first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= shown)
    samples = first.groupBy(technology_col).agg(
        F.count("*").alias("chunk_count"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("_n", "_head"))), lambda s: s["_head"]
        ).alias("sample_content"),
    )
    return counts.join(samples, technology_col)


def corpus_status(
    rows: DataFrame, source_col: str = "source", technology_col: str = "technology"
) -> DataFrame:
    """One row: rows, distinct sources, distinct technologies, supported formats."""
    return rows.agg(
        F.count("*").alias("document_count"),
        F.count_distinct(source_col).alias("sources"),
        F.count_distinct(technology_col).alias("technologies"),
    ).withColumn("formats", F.lit(len(C.FORMATS)).cast("bigint"))
