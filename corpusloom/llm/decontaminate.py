"""Benchmark decontamination with spaced seeds.

A seed is a mask over ten tokens that looks at six of them, so it still matches where the tokens it
ignores were changed. Hashes under each mask are taken at every position of the benchmark items
and of the documents and joined. Around a hit the two texts are laid over each other, and an
overlap counts when a window of it agrees in most of its tokens.

Only built-in column functions are used. Documents are not shuffled for the hash join as long as
the benchmark's hashes are few enough to be broadcast, which is counted; otherwise it is a shuffled
join with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.joins import small_side
from corpusloom.session import written

MASKS = ((0, 1, 3, 6, 8, 9), (0, 2, 4, 5, 7, 9))
SPAN = 10
WINDOW = 20  # tokens that must agree mostly; the whole item where it is shorter
AGREE = 0.8


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _masked(number: int, mask: tuple[int, ...]):
    return lambda i: F.xxhash64(F.lit(number), *[F.get("_h", i + o) for o in mask])


def _seeds(rows: DataFrame, masks=MASKS) -> DataFrame:
    """``rows`` (with ``_tokens``) times every position: mask, at and hash."""
    # No filter for short texts: it would be pushed below and cut every text twice.
    rows = rows.withColumn("_h", F.transform("_tokens", lambda t: F.xxhash64(t)))
    places = F.when(F.size("_h") >= SPAN, F.sequence(F.lit(0), F.size("_h") - SPAN))
    places = F.coalesce(places, F.expr("CAST(array() AS array<int>)"))
    hashes = F.concat(*[F.transform(places, _masked(m, mask)) for m, mask in enumerate(masks)])
    rows = rows.select(*[c for c in rows.columns if c not in ("_tokens", "_h")], F.size("_h").alias("_n"), F.posexplode(hashes).alias("_p", "hash"))
    return rows.withColumn("at", F.col("_p") % (F.col("_n") - (SPAN - 1))).drop("_p", "_n")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, _digest, item_id, shift) of documents and items that share a seed; the
    shift is the document's position less the item's."""
    known = _seeds(items.select("item_id", "_tokens")).withColumnRenamed("at", "item_at").distinct()
    known, _ = small_side(known, "seeds")
    found = _seeds(docs.select("doc_id", "_digest", "_tokens")).join(known, "hash")
    return found.select("doc_id", "_digest", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def overlaps(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, agree: float = AGREE,
) -> DataFrame:
    """One row per document and item with an overlap: doc_id, _digest (a hash of the text),
    item_id, item_tokens, matched (equal tokens of the best alignment) and places (alignments).

    Null and empty texts have no tokens; texts and items under ten tokens have no seed and no
    overlap. Items with one id and text count once, rows of ``docs`` with one key and text too.
    Empty tables give no rows; further columns are ignored.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("_digest"), F.col(text).alias("_text")
    ).where(F.col("_text").isNotNull())
    tests = items.select(F.col(item).alias("item_id"), tokens_of(F.col(item_text)).alias("_tokens")).distinct()
    found = written(hits(rows.select("doc_id", "_digest", tokens_of(F.col("_text")).alias("_tokens")), tests), "hits")
    pairs = found.groupBy(F.col("doc_id").alias("_id"), F.col("_digest").alias("_d"), "item_id").agg(
        F.collect_set("shift").alias("shifts")
    )
    # Only texts with a hit are shuffled, once each; they are picked out where they lie.
    same_text = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d"))
    wanted, _ = small_side(pairs.select("_id", "_d").distinct(), "texts")
    near = rows.join(wanted, same_text, "left_semi").distinct().join(pairs, same_text).withColumn("_doc", tokens_of(F.col("_text"))).select("doc_id", "_digest", "item_id", "shifts", "_doc")
    own = tests.select(F.col("item_id").alias("_item"), "_tokens")
    laid = near.join(own, F.col("item_id").eqNullSafe(F.col("_item")))
    laid = laid.select("doc_id", "_digest", "item_id", "_doc", "_tokens", F.explode("shifts").alias("shift"))
    size = F.size("_tokens")
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(size, F.size("_doc") - F.col("shift"))  # exclusive
    same = F.transform(
        F.sequence(low, high - 1),
        lambda p: F.when(F.get("_doc", p + F.col("shift")) == F.get("_tokens", p), 1).otherwise(0),
    )
    laid = laid.where(high > low).select("doc_id", "_digest", "item_id", size.alias("item_tokens"), same.alias("same"))
    long = F.least(F.lit(window), F.col("item_tokens"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    good = F.exists(
        F.sequence(F.lit(1), F.size("same") - long + 1),
        lambda s: total(F.slice("same", s, long)) >= F.ceil(long * agree),
    )
    kept = laid.where((F.size("same") >= long) & good)
    return kept.groupBy("doc_id", "_digest", "item_id").agg(
        F.max("item_tokens").alias("item_tokens"), F.max(total(F.col("same"))).alias("matched"),
        F.count(F.lit(1)).alias("places"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that overlap with an item. All other rows stay as they are."""
    bad = written(
        overlaps(docs, items, key, text, **options).select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_d")).distinct(),
        "overlaps",
    )
    return docs.join(
        bad, docs[key].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text]) == bad["_d"]), "left_anti"
    )
