"""Registered queries over ``documents``: digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, lm, near, packing, pii, sharding
from corpusloom.plans.tables import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, TOKENIZER, end=2, capacity=4096)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 5) == 0)
    net = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, net, keep=("doc_id", "held_out"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select(
        "doc_id", (F.octet_length(content).cast("bigint") + 1).alias("size"), F.crc32(content).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 10) == 0)
    return lm.score(docs)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = pii.spans_text(F.col("base"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", *[F.when(t != "", t) for t in (base, pii.spans_text(F.col("added")))]).alias("spans"),
    )
