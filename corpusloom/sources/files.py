"""Directories of mixed files, scraped JSON, saved chunks."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.predicates import file_problem
from corpusloom.functions.text import base_name, file_extension
from corpusloom.operators.stats import chunk_counts, chunk_stats
from corpusloom.schemas import SCRAPED
from corpusloom.sources.office import HANDLERS, table_profile
from corpusloom.sources.records import csv_records, json_elements

PROCESSOR = "corpusloom"
_PARSED = (
    "content string, error string, stats map<string,bigint>, column_names array<string>, "
    "sheets array<struct<name:string,rows:bigint,columns:bigint>>"
)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path as (path, modificationTime, length, content). Files of zero length have
    no content to extract, and the file source makes no row for them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def _parse(kinds: pd.Series, data: pd.Series) -> pd.DataFrame:
    rows = []
    for kind, content in zip(kinds, data):
        row = {"content": "", "error": None, "stats": {}, "column_names": None, "sheets": None}
        if kind in HANDLERS and content is not None:
            handler, label = HANDLERS[kind]
            try:
                row |= handler(bytes(content))
            except Exception as e:  # a damaged file gives an error row
                row["error"] = f"{label} processing failed: {e}"
        rows.append(row)
    return pd.DataFrame(rows, columns=["content", "error", "stats", "column_names", "sheets"])


def rtf_text(c: Column) -> Column:
    """Text of simple RTF: control words, braces and backslashes dropped."""
    plain = F.regexp_replace(c, r"\\[a-z]+\d*\s?", "")
    return F.replace(F.regexp_replace(plain, r"[{}]", ""), F.lit("\\"), F.lit(""))


def extract(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per file: text, format, success or error, counts.

    Text and RTF are decoded by built-in functions. Only the bytes of zipped office files and
    small CSV files are sent to Python; for all other rows the function gets nulls, so the
    files are read once.
    """
    carried = [c for c in files.columns if c not in (path, content, "modificationTime", "length")]
    name = base_name(F.col(path))
    pairs = [F.lit(x) for kv in C.FORMATS.items() for x in kv]
    kind = F.try_element_at(F.create_map(*pairs), F.col("file_type"))
    in_python = F.col("format").isin(*HANDLERS)
    data = F.when(in_python, F.col("_bytes"))
    named = files.select(*carried, name.alias("filename"), F.col(content).alias("_bytes"))
    named = named.withColumn("file_type", file_extension("filename")).withColumn("format", kind)
    parse = F.pandas_udf(_parse, _PARSED)
    parsed = named.withColumn("_parsed", parse(F.when(in_python, F.col("format")), data))
    raw = F.col("_bytes").cast("string")
    utf8 = F.is_valid_utf8(raw)
    text = F.when(utf8, raw).otherwise(F.decode(F.col("_bytes"), "ISO-8859-1"))
    is_text, is_rtf = F.col("format") == "text", F.col("format") == "rtf"
    error = (
        F.when(F.col("format").isNull(), F.concat(F.lit("Unsupported format: "), F.col("file_type")))
        .when(is_rtf & ~utf8, "RTF processing failed: not valid UTF-8")
        .otherwise(F.col("_parsed.error"))
    )
    body = (
        F.when(is_text, text).when(is_rtf & utf8, rtf_text(raw)).otherwise(F.col("_parsed.content"))
    )
    return parsed.select(
        *carried,
        "filename",
        "file_type",
        F.when(error.isNull(), F.col("format")).alias("format"),
        F.when(error.isNull(), body).otherwise(F.lit("")).alias("content"),
        F.lit(PROCESSOR).alias("processor"),
        error.isNull().alias("success"),
        error.alias("error"),
        F.when(is_text & ~utf8, "latin-1").alias("encoding"),
        F.col("_parsed.stats").alias("stats"),
        F.col("_parsed.column_names").alias("column_names"),
        F.col("_parsed.sheets").alias("sheets"),
    )


def latest_named(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with ``superseded``: whether another one of the same base name is newer (or as new and
    its path comes later). Only names, times and paths are shuffled."""
    when = F.struct(F.col("modificationTime").alias("made"), F.col(path).alias("at"))
    named = files.withColumn("_name", base_name(F.col(path)))
    last = named.groupBy("_name").agg(F.max(when)["at"].alias("_last"))
    out = named.join(last, "_name", "left").withColumn("superseded", F.col(path) != F.col("_last"))
    return out.drop("_name", "_last")


def gate(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files with the reason why they are not accepted, null for those that are."""
    suffix = file_extension(base_name(F.col(path)))
    return files.withColumn("problem", file_problem(suffix, F.col(content)))


def supported_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.FORMATS.items()), "file_type string, format string")


def read_scraped(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON array files of documents from those paths that exist, concatenated: the usual columns,
    ``extra`` (a map of all other keys to their JSON text, null if none), and ``read_error`` (null
    for documents; what is no document, and a file that is no JSON array, gives one row with it)."""
    whole = spark.createDataFrame([], "value string, path string")
    for path in paths:
        try:
            found = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
            whole = whole.unionByName(found.select("value", F.col("_metadata.file_path").alias("path")))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return _documents(whole)


def read_scraped_large(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same from files of any size: each is cut into documents by many tasks, and never held as
    one row. Of a file that breaks off or turns bad, the documents before that are kept, beside the
    row with the error."""
    found = []
    for path in paths:
        try:
            spark.read.text(path, recursiveFileLookup=True)
            found.append(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        return _documents(spark.createDataFrame([], "value string, path string"))
    return _documents(json_elements(spark, found).select("value", "path"))


def _documents(whole: DataFrame) -> DataFrame:
    """Documents and errors of texts that should be JSON arrays."""
    # Kept as variants, every key of a document survives whatever its type.
    document = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    parsed = whole.select("path", document.alias("_docs"))
    bad = F.when(F.col("_docs").isNull(), F.concat(F.lit("not a JSON array of documents: "), "path"))
    rows = parsed.select(bad.alias("_bad"), "path", F.explode_outer("_docs").alias("_doc"))
    rows = rows.where("_doc IS NOT NULL OR _bad IS NOT NULL")
    known = [F.try_variant_get("_doc", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in SCRAPED.fields]
    every = F.try_variant_get("_doc", "$", "map<string,variant>")
    names = F.array(*[F.lit(f.name) for f in SCRAPED.fields])
    extra = F.map_filter(every, lambda k, v: ~F.array_contains(names, k))
    extra = F.when(F.size(extra) > 0, F.transform_values(extra, lambda k, v: F.to_json(v)))
    odd = F.when(every.isNull(), F.concat(F.lit("not a document: "), "path"))
    return rows.select(*known, extra.alias("extra"), F.coalesce("_bad", odd).alias("read_error"))


def csv_rows(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(rows of the CSV files below a path, their column names). Every file begins with a header; the
    names are those of the first file. Fields may hold line ends within quotes, and still each file
    is read by many tasks. Rows have their columns as strings in ``fields``, their place as path,
    block and at, their text as value, and ``problem``: not null where quotes are not closed."""
    records = csv_records(spark, path)
    head = records.orderBy("path", "block", "at").limit(1).collect()
    names = next(csv.reader(io.StringIO(head[0]["value"]))) if head and head[0]["value"] else []
    place = F.struct("block", "at")
    first = records.groupBy("path").agg(F.min(place).alias("_first"))  # a row per file
    rows = records.join(first, "path").where(place > F.col("_first")).drop("_first")
    schema = ", ".join(f"_c{i} string" for i in range(max(1, len(names))))
    parsed = F.from_csv("value", schema, {"quote": '"', "escape": '"'})
    fields = F.array(*[parsed[f"_c{i}"] for i in range(len(names))]).cast("array<string>")
    problem = F.when(F.col("value").isNull(), "quotes are not closed")
    return rows.select("path", "block", "at", fields.alias("fields"), "value", problem.alias("problem")), names


def large_csv_profile(spark: SparkSession, path: str) -> DataFrame:
    """Profile of a CSV file or folder too large for one row: counted by Spark, and only the first
    rows come back for the preview."""
    rows, names = csv_rows(spark, path)
    good = rows.where("problem IS NULL")
    count = good.count()
    head = [r["value"] for r in good.orderBy("path", "block", "at").limit(C.CSV_PREVIEW_ROWS).collect()]
    shown = pd.read_csv(io.StringIO("\n".join(head)), names=names, header=None) if head else pd.DataFrame(columns=names)
    return spark.createDataFrame(
        [(table_profile(count, names, shown), count, len(names), names)],
        "content string, rows bigint, columns bigint, column_names array<string>",
    )


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON, with their statistics and their numbers by type and by source in folders
    beside them."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    saved = chunks.sparkSession.read.schema(chunks.schema).json(f"{path}/chunks")
    chunk_stats(saved).coalesce(1).write.mode("overwrite").json(f"{path}/chunk_stats")
    for name in {"chunk_type", "source"} - set(saved.columns):
        saved = saved.withColumn(name, F.lit(None).cast("string"))
    chunk_counts(saved).coalesce(1).write.mode("overwrite").json(f"{path}/chunk_counts")


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of saved chunks by type (grouping 1), by source (2), and in all (3)."""
    schema = "chunk_type string, source string, chunks bigint, grouping bigint"
    return spark.read.schema(schema).json(f"{path}/chunk_counts")


def load_chunks(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/chunks")
