"""A stored term index, and ranking by it that reads only the blocks that can matter.

Documents are cut into segments where they lie, those of similar norm together. A block is what one
term has in one segment: the documents, their weights, and the greatest weight among them. Blocks
lie in files by a hash of the term, sorted by term, so that a question reads its own terms' files.

A document weighs each of its terms by 1 + ln(tf), at unit length: nothing of the other documents.
So documents are added by adding blocks, and nothing that is stored changes; how rare a term is
follows from the block sizes when questions come.

The greatest weights bound what any document of a segment can score. Each question first scores the
segments of the highest bounds, a few and then some more; its k-th best score so far rules out all
segments with a lower bound, and only the rest is read. The result is that of scoring every
document. Small segments have tight bounds and many blocks; questions of few or rare words leave
the most unread.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from corpusloom.functions.batches import cut
from corpusloom.functions.vectors import DECIMALS
from corpusloom.operators import joins
from corpusloom.operators.embedding import terms
from corpusloom.operators.joins import small_side
from corpusloom.operators.search import MAX_BROADCAST_QUERIES, best_k
from corpusloom.session import spread, written

SEGMENT = 1024  # documents
BUCKETS = 32  # of terms
HELD_BYTES = 8 << 20  # words that a task sorts at a time; arrays of these take some twenty times as much
WAVES = (8, 64)  # segments that a question scores before it rules others out, and then again
_SLACK = 2 * 10.0**-DECIMALS  # bounds and scores are sums in different orders, and scores are rounded


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


# --- building -------------------------------------------------------------------------------------


def _blocks(ids: pa.Array, words: pa.Array, size: int, first: int) -> tuple[pa.RecordBatch, int]:
    """The blocks of some documents, whose words have single blanks between them, and the number of
    segments. The row of the empty term has the documents of a segment."""
    lists = pc.split_pattern(words, " ")
    coded = pc.list_flatten(lists).dictionary_encode()
    width = max(1, len(coded.dictionary))
    pair, count = np.unique(pc.list_parent_indices(lists).to_numpy() * width + coded.indices.to_numpy(), return_counts=True)
    doc, code = pair // width, pair % width
    real = ~pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[code]  # a text without words
    doc, code, weight = doc[real], code[real], 1.0 + np.log(count[real])
    norm = np.sqrt(np.bincount(doc, weight * weight, len(words)))
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(norm, kind="stable")] = np.arange(len(words))
    segment = rank // size
    # One entry for the document itself, under a code of its own, stands before all of its terms.
    doc = np.concatenate([np.arange(len(words)), doc])
    code = np.concatenate([np.full(len(words), -1), code])
    weight = np.concatenate([np.zeros(len(words)), weight / norm[doc[len(words):]]])
    order = np.lexsort((doc, code, segment[doc]))
    doc, code, weight = doc[order], code[order], weight[order]
    key = segment[doc] * (width + 1) + code + 1
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    offsets = pa.array(np.append(starts, len(doc)).astype(np.int32))
    names = pa.concat_arrays([pa.array([""]), coded.dictionary.cast(pa.string())]).take(pa.array(code[starts] + 1))
    top = np.maximum.reduceat(weight, starts) if len(starts) else weight
    columns = [
        pa.array(first + segment[doc[starts]]), names, pa.array(np.diff(np.append(starts, len(doc))).astype(np.int64)),
        pa.array(top), pa.ListArray.from_arrays(offsets, ids.take(pa.array(doc))),
        pa.ListArray.from_arrays(offsets, pa.array(weight)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "term", "n", "top", "ids", "weights"]), int(segment.max()) + 1


def _invert(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 24
    held: list[pa.RecordBatch] = []

    def made():
        nonlocal first
        whole = pa.Table.from_batches(held).combine_chunks()
        out, count = _blocks(whole.column(0).combine_chunks(), whole.column(1).combine_chunks(), size, first)
        first += count
        return out

    for batch in cut(batches, 1):
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= HELD_BYTES:
            yield made()
            held = []
    if held:
        yield made()


def add(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> None:
    """Add documents to the index at ``path``, which the first add makes. Ids that the index has
    already are indexed once more: it is for the caller to add each document once. A null text
    has no terms. All of an add appears when its job commits."""
    kind = docs.schema[id_col].dataType
    words = F.array_join(terms(F.coalesce(F.col(text_col), F.lit(""))), " ").alias("_words")
    schema = StructType([*_schema(kind).fields[:6]])
    rows = spread(docs.select(F.col(id_col).alias("_id"), words)).mapInArrow(partial(_invert, size=segment), schema)
    rows = rows.withColumn("bucket", _bucket(F.col("term"), BUCKETS)).hint("rebalance", "bucket")
    rows = rows.sortWithinPartitions("bucket", "term", "segment")
    rows.write.partitionBy("bucket").parquet(f"{path}/add={uuid.uuid4().hex[:12]}")


def _schema(kind) -> StructType:
    return StructType([
        StructField("segment", LongType()), StructField("term", StringType()), StructField("n", LongType()),
        StructField("top", DoubleType()), StructField("ids", ArrayType(kind)), StructField("weights", ArrayType(DoubleType())),
        StructField("add", StringType()), StructField("bucket", IntegerType()),
    ])


def read(spark: SparkSession, path: str, id_type) -> DataFrame:
    """All blocks: add, segment, term, n (documents), top (weight), ids and weights; ``id_type`` is
    the type of the document ids. A scan reads the named columns and the files of the named terms."""
    return spark.read.schema(_schema(id_type)).option("basePath", path).parquet(path)


# --- ranking --------------------------------------------------------------------------------------


def _rank(blocks: pa.Table, asked: pa.Table, shared, k: int, names: list[str], types: list) -> pa.Table:
    """The k best documents of one segment for each question that needs it."""
    weights = shared.value
    blocks = blocks.combine_chunks()
    empty = pa.table([pa.array([], t) for t in types], names=names)
    if not blocks.num_rows or not asked.num_rows:
        return empty
    number = {t: i for i, t in enumerate(blocks["term"].to_pylist())}
    sizes = blocks["n"].to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    every = blocks["ids"].combine_chunks().flatten()
    codes = every.dictionary_encode()
    doc, ids = codes.indices.to_numpy(), codes.dictionary.to_numpy(zero_copy_only=False)
    ids = ids.astype(str) if ids.dtype == object else ids
    weight = blocks["weights"].combine_chunks().flatten().to_numpy()
    out: list[list] = [[], [], []]
    for query in asked["_query"].to_pylist():
        total = np.zeros(len(ids))
        for term, w in weights[query]:
            i = number.get(term)
            if i is not None:
                part = slice(starts[i], starts[i + 1])
                total[doc[part]] += w * weight[part]
        cost = -np.round(total, DECIMALS)
        hit = np.flatnonzero(cost < 0)
        if len(hit) > k:
            hit = hit[cost[hit] <= np.partition(cost[hit], k - 1)[k - 1]]
        hit = hit[np.lexsort((ids[hit], cost[hit]))[:k]]
        out[0] += [query] * len(hit)
        out[1] += ids[hit].tolist()
        out[2] += cost[hit].tolist()
    return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=names)


class _Block:
    """One block of questions: their weights, and what they score in given segments."""

    def __init__(self, index: DataFrame, weighed: DataFrame, k: int, id_type):
        self.index, self.k = index, k
        spark = index.sparkSession
        self.weighed = weighed
        by_query: dict = {}
        for query, term, w in weighed.orderBy("_query", "term").collect():  # one block of questions
            by_query.setdefault(query, []).append((term, w))
        self.shared = spark.sparkContext.broadcast(by_query)
        fields = [weighed.schema["_query"], StructField("_id", id_type), StructField("_cost", DoubleType())]
        self.schema = StructType([StructField(n, f.dataType) for n, f in zip(("_query", "_id", "_cost"), fields)])

    def score(self, needed: DataFrame) -> DataFrame:
        """``needed``: _query, add, segment. Reads the blocks of these segments for these questions'
        terms, each once."""
        from pyspark.sql.pandas.types import to_arrow_type

        wanted = needed.join(self.weighed.select("_query", "term"), "_query").select("add", "segment", "term").distinct()
        wanted, count = small_side(wanted.withColumn("bucket", _bucket(F.col("term"), BUCKETS)), "wanted")
        rows = self.index.join(wanted, ["bucket", "add", "segment", "term"], "left_semi").select(
            "add", "segment", "term", "n", "ids", "weights"
        )
        shared, k, names = self.shared, self.k, self.schema.names
        types = [to_arrow_type(f.dataType) for f in self.schema.fields]
        found = rows.groupBy("add", "segment").cogroup(
            needed.select("_query", F.col("add").alias("_add"), F.col("segment").alias("_segment")).groupBy("_add", "_segment")
        ).applyInArrow(lambda left, right: _rank(left, right, shared, k, names, types), self.schema)
        return written(found, "scored")


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 5, id_type: str = "long", id_col: str = "doc_id",
    query_id: str = "query_id", query_text: str = "query_text",
) -> tuple[DataFrame, DataFrame]:
    """(hits, report). Hits are those of ``embedding.term_search`` over all documents of the index:
    query id, rank, document id and score, ties by id. The report has for each question how many
    blocks the index has of its terms, and how many of them were read for it.

    Questions are taken in blocks within the broadcast bound. What is shuffled are the blocks read
    and the bounds of one segment for one question each, not postings.
    """
    kind = StructType.fromDDL(f"x {id_type}").fields[0].dataType
    index = read(spark, path, kind)
    size = index.where((F.col("term") == "") & (F.col("bucket") == _empty_bucket())).agg(F.sum("n")).first()[0] or 0
    words = queries.select(F.explode(terms(query_text)).alias("term")).distinct()
    words, _ = small_side(words.withColumn("bucket", _bucket(F.col("term"), BUCKETS)), "question-terms")
    tops = written(index.select("bucket", "add", "segment", "term", "n", "top").join(words, ["bucket", "term"], "left_semi"), "tops")
    frequency = tops.groupBy("term").agg(F.sum("n").alias("df"))
    asked = queries.select(F.col(query_id).alias("_query"), F.explode(terms(query_text)).alias("term"))
    asked = asked.groupBy("_query", "term").agg(F.count("*").alias("_tf")).join(frequency, "term")
    weight = (1.0 + F.log("_tf")) * F.log(F.lit(float(size)) / F.col("df"))
    asked = asked.select("_query", "term", weight.alias("_w")).where("_w > 0")
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("_query")))
    asked = written(asked.select("_query", "term", (F.col("_w") / norm).alias("_w")), "questions")
    total = asked.select("_query").distinct().count()
    blocks = max(1, -(-total // MAX_BROADCAST_QUERIES))
    hits: DataFrame | None = None
    report: DataFrame | None = None
    for number in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("_query"), F.lit(blocks)) == number) if blocks > 1 else asked
        found, seen = _search_block(index, tops, mine, k, kind)
        hits = found if hits is None else hits.unionByName(found)
        report = seen if report is None else report.unionByName(seen)
    ranked = best_k(hits, "_query", ["_cost", "_id"], k)
    ranked = ranked.select(F.col("_query").alias(query_id), "rank", F.col("_id").alias(id_col), (-F.col("_cost")).alias("score"))
    return ranked, report.withColumnRenamed("_query", query_id)


def _empty_bucket() -> int:
    return 0  # crc32 of nothing


def _search_block(index: DataFrame, tops: DataFrame, weighed: DataFrame, k: int, kind) -> tuple[DataFrame, DataFrame]:
    block = _Block(index, weighed, k, kind)
    small = weighed.count() <= joins.SMALL_ROWS  # at most MAX_BROADCAST_QUERIES questions
    bound = tops.join(F.broadcast(weighed) if small else weighed, "term").groupBy("_query", "add", "segment").agg(
        F.sum(F.col("_w") * F.col("top")).alias("_bound"), F.count("*").alias("_blocks")
    )
    bound = written(bound, "bounds")
    best = Window.partitionBy("_query").orderBy(F.desc("_bound"), "add", "segment")
    found: DataFrame | None = None
    done: DataFrame | None = None
    for most in (*WAVES, None):
        open_ = bound
        if done is not None:
            kth = best_k(found, "_query", ["_cost", "_id"], k).where(F.col("rank") == k)
            kth = kth.select(F.col("_query").alias("_of"), (-F.col("_cost")).alias("_least"))  # a row per question
            open_ = open_.join(F.broadcast(kth), bound["_query"] == kth["_of"], "left")
            open_ = open_.where(F.col("_bound") + F.lit(_SLACK) >= F.coalesce("_least", F.lit(0.0)))
            open_ = open_.join(done.select("_query", "add", "segment"), ["_query", "add", "segment"], "left_anti")
        if most is not None:
            open_ = open_.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
        wave = written(open_.select("_query", "add", "segment", "_blocks"), "wave")
        scored = block.score(wave)
        found = scored if found is None else found.unionByName(scored)
        done = wave if done is None else done.unionByName(wave)
    read_ = done.groupBy("_query").agg(F.sum("_blocks").alias("read"))
    seen = bound.groupBy("_query").agg(F.sum("_blocks").alias("blocks")).join(read_, "_query")
    return found, seen
