"""The document pipeline: each stage reads what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the
last returns packed pieces. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, langid, near, packing, pii
from corpusloom.llm.document_queries import TOKENIZER, remainder
from corpusloom.plans.tables import table
from corpusloom.session import written

MIN_SCORE = 0.4  # documents of less certain language go, and those without letters


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised. The network learns from labelled documents
    that are not held out."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # own names can't clash
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    key, text, lang = (names[c] for c in ("doc_id", "text", "lang"))
    net = langid.fit(rows.where(remainder(key, 5) != 0), key, text, lang)
    found = langid.predict(rows, net, text, keep=tuple(names.values()))
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return found.where(sure).select(*[F.col(n).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the least id."""
    return near.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that overlap with no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and terms that disclose it, in the texts."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]
ORACLE_SQL = None  # a trained network, hashes and bin packing have no SQL twin


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
