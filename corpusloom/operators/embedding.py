"""Text to vectors with a cache table, and ranking by weighted terms."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from corpusloom import constants as C
from corpusloom.functions.batches import cut
from corpusloom.functions.predicates import cacheable_text
from corpusloom.functions.text import embedding_key
from corpusloom.functions.vectors import DECIMALS, TopK
from corpusloom.operators.joins import SMALL_ROWS, lookup_join, small_side
from corpusloom.operators.search import MAX_BROADCAST_QUERIES, best_k
from corpusloom.session import written

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


class _Slots(dict):
    """Slot of a term: the first 32 bits of its md5, modulo the dimension. Filled as terms come,
    and started anew when it holds very many."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, term: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        slot = self[term] = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % self.dim
        return slot

    def counts(self, words: str | None) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words.split(" ") if words else ()), dtype=np.int64)
        return np.bincount(found, minlength=self.dim)


@lru_cache(maxsize=4)
def _slots(dim: int) -> _Slots:
    """One table for a worker, whatever the number of batches."""
    return _Slots(dim)


@dataclass(frozen=True)
class TermModel:
    """Weight of each slot, and the column that is read."""

    weights: np.ndarray
    text_col: str = "text"


def _words(text_col: str) -> Column:
    """The terms of a text as one string, which travels to Python far faster than a list."""
    return F.array_join(terms(F.coalesce(F.col(text_col), F.lit(""))), " ")


def fit_vectoriser(corpus: DataFrame, text_col: str = "text", dim: int = C.EMBEDDING_DIM) -> TermModel:
    """Default vectoriser: hashed term counts, weighted by rarity, unit length. A slot weighs
    ln((N + 1) / (documents with it + 1)). Null texts count as empty."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, seen = _slots(dim), np.zeros(dim + 1, dtype=np.int64)
        for batch in cut(batches, 0):
            for words in batch.column(0).to_pylist():
                seen[:dim] += slots.counts(words) > 0
            seen[dim] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(seen)], names=["slot", "n"])

    parts = corpus.select(_words(text_col)).mapInArrow(frequencies, "slot long, n long")
    seen = np.zeros(dim + 1)
    for slot, n in parts.groupBy("slot").agg(F.sum("n")).collect():  # dim + 1 rows
        seen[slot] = n
    return TermModel(np.log((seen[dim] + 1.0) / (seen[:dim] + 1.0)), text_col)


def vectorise(docs: DataFrame, model: TermModel, out: str = "embedding") -> DataFrame:
    dim = len(model.weights)

    def vectors(words: pd.Series) -> pd.Series:
        slots, made = _slots(dim), []
        for text in words:
            weighted = slots.counts(text) * model.weights
            norm = math.sqrt(float(weighted @ weighted))
            made.append((weighted / norm if norm else weighted).astype(np.float32))
        return pd.Series(made)

    return docs.withColumn(out, F.pandas_udf(vectors, "array<float>")(_words(model.text_col)))


def model_hook(embed: Callable[[list[str]], list[list[float]]], text_col: str = "text", out: str = "embedding"):
    """Turn a user's ``list of texts -> list of vectors`` function into a vectoriser of frames."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embed(texts.tolist()), index=texts.index)

    return lambda docs: docs.withColumn(out, run(text_col))


def embed_with_cache(
    rows: DataFrame,
    cache: DataFrame,
    vectoriser: Callable[[DataFrame], DataFrame],
    text_col: str = "text",
    order_col: str = "doc_id",
    model: str = "default",
) -> tuple[DataFrame, DataFrame]:
    """(rows with key and embedding, new cache entries).

    Every distinct text is embedded once, and only when the cache (key, embedding) lacks it: what
    was embedded is written, and both results read it.
    ``order_col`` is a unique id; of equal texts the one with the lowest id is embedded.
    Texts too short to be cached are embedded too, but not stored.
    """
    keyed = rows.withColumn("key", embedding_key(text_col, model))
    # Keys are settled on narrow rows first; the texts that miss are then picked by their id.
    first = keyed.groupBy("key").agg(F.min(order_col).alias(order_col))
    missing, _ = small_side(first.join(cache.select("key"), "key", "left_anti").select(order_col), "missing")
    misses = keyed.join(missing, order_col, "left_semi").select("key", text_col)
    fresh = written(vectoriser(misses).select(
        "key", "embedding", F.length(text_col).cast("bigint").alias("text_length"),
        cacheable_text(text_col).alias("_cacheable"),
    ), "fresh")
    known = cache.select("key", "embedding").unionByName(fresh.select("key", "embedding"))
    store = fresh.where("_cacheable").select("key", "embedding", "text_length")
    return lookup_join(keyed, known, "key"), store


# --- ranking by weighted terms -------------------------------------------------------------------


def terms(text: Column | str = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def term_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "query_id",
    query_text: str = "query_text",
) -> DataFrame:
    """Best documents per question by cosine of log-weighted terms.

    Question terms weigh (1 + ln tf) * ln(N / df), document terms 1 + ln tf; both sides have
    unit length. The document side needs nothing but its own text, so a document is scored where
    it lies: one pass counts the question terms' document frequencies, one pass scores, and only
    k rows per question and task are shuffled. Questions above the broadcast bound are scored in
    bounded blocks.
    """
    total, size = queries.count(), docs.count()
    blocks = max(1, -(-total // MAX_BROADCAST_QUERIES))
    # Frequencies of the words of all questions, in one pass over the documents.
    words = queries.select(F.explode(terms(query_text)).alias("term")).distinct()
    words, _ = small_side(words, "question-terms")
    frequency = written(document_frequencies(docs, words, text_col), "frequencies")
    asked = queries.select(F.col(query_id).alias("_query"), F.explode(terms(query_text)).alias("term"))
    asked = asked.groupBy("_query", "term").agg(F.count("*").alias("_tf")).join(frequency, "term")
    weight = (1.0 + F.log("_tf")) * F.log(F.lit(float(size)) / F.col("df"))
    asked = written(asked.select("_query", "term", weight.alias("_weight")), "questions")
    found: DataFrame | None = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("_query"), F.lit(blocks)) == block) if blocks > 1 else asked
        part = _score_block(docs, mine, k, id_col, text_col, query_id)
        found = part if found is None else found.unionByName(part)
    return best_k(found, query_id, ["_cost", id_col], k).select(
        query_id, "rank", id_col, (-F.col("_cost")).alias("score")
    )


def document_frequencies(docs: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents per word, for the given words only (column ``term``)."""
    seen = docs.select(F.explode(F.array_distinct(terms(text_col))).alias("term"))
    return seen.join(words, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


class Postings:
    """Questions and weights by term, as arrays."""

    CELLS = 1 << 20  # documents times questions scored at a time

    def __init__(self, terms: dict[str, list[tuple[int, float]]]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.size = np.array([len(p) for p in terms.values()], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.rows = np.array([r for p in terms.values() for r, _ in p], dtype=np.int64)
        self.weights = np.array([w for p in terms.values() for _, w in p])

    def scores(self, words: pa.Array, questions: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, scores of documents by questions) for texts given as words with single
        blanks between them. Weights of a document's terms: 1 + ln of their number, at unit length."""
        lists = pc.split_pattern(words.fill_null(""), " ")
        parent = pc.list_parent_indices(lists).to_numpy()
        coded = pc.list_flatten(lists).dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        width = max(1, len(vocabulary))
        pair, count = np.unique(parent * width + coded.indices.to_numpy(), return_counts=True)
        doc, code = pair // width, pair % width
        weight = 1.0 + np.log(count)
        norm = np.sqrt(np.bincount(doc, weights=weight * weight, minlength=len(words)))
        term = np.array([self.number.get(w, -1) for w in vocabulary], dtype=np.int64)[code]
        known = term >= 0
        doc, term, weight = doc[known], term[known], (weight / norm[doc])[known]
        step = max(1, self.CELLS // max(1, questions))
        for at in range(0, len(words), step):
            low, high = np.searchsorted(doc, [at, at + step])
            some, size = term[low:high], self.size[term[low:high]]
            if not len(some):
                continue
            # All postings of all terms, one behind the other.
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            entry = np.repeat(self.start[some], size) + inside
            cell = (np.repeat(doc[low:high], size) - at) * questions + self.rows[entry]
            count_docs = min(step, len(words) - at)
            total = np.bincount(cell, np.repeat(weight[low:high], size) * self.weights[entry], count_docs * questions)
            yield at, total.reshape(count_docs, questions)


def _score_block(docs, asked, k, id_col, text_col, query_id) -> DataFrame:
    """``asked``: _query, term and _weight of one block of questions."""
    spark = docs.sparkSession
    # Bounded by the block: the words of at most MAX_BROADCAST_QUERIES questions.
    by_query: dict = {}
    for query, term, value in asked.orderBy("_query", "term").collect():
        by_query.setdefault(query, []).append((term, value))
    postings: dict[str, list[tuple[int, float]]] = {}
    for row, weights in enumerate(by_query.values()):
        norm = math.sqrt(sum(w * w for _, w in weights))
        for t, w in weights:
            if w:
                postings.setdefault(t, []).append((row, w / norm))
    shared = spark.sparkContext.broadcast((list(by_query), Postings(postings)))
    schema = f"`{query_id}` {dict(asked.dtypes)['_query']}, `{id_col}` {dict(docs.dtypes)[id_col]}, `_cost` double"
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, postings = shared.value
        best = TopK(len(keys), k)
        for batch in cut(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if ids.dtype == object else ids
            for at, scores in postings.scores(batch.column(1), len(keys)):
                cost = -np.round(scores, DECIMALS)
                docs_hit, rows_hit = np.nonzero((cost < 0) & (cost <= best.limit[None]))
                best.push(rows_hit, cost[docs_hit, rows_hit], ids[at + docs_hit])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(best.columns(keys), types)],
            names=[query_id, id_col, "_cost"],
        )

    # One string per document travels to Python far faster than a list of strings.
    words = F.array_join(terms(text_col), " ").alias("_terms")
    return docs.select(id_col, words).mapInArrow(task, schema)
