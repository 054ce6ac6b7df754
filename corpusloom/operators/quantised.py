"""Approximate search over short codes: product-quantised residuals in cells, exactly re-ranked.

Each vector goes to its nearest cell centre; what is left of it is cut into parts, and each part is
named by the nearest entry of a small book. A search reads the codes (a byte for each part): distances
are sums over tables made once for each question and cell. The best candidates' vectors are then
read, from their cells only, and measured exactly. Where vectors do lie in clusters, a search may be
held to the cells nearest to a question; in scattered data its neighbours are in any cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from corpusloom import constants as C
from corpusloom.functions.text import similarity
from corpusloom.functions.vectors import DECIMALS, TopK, distance, finite
from corpusloom.operators.search import _gaps, _searchable, best_k, query_blocks
from corpusloom.session import scratch_path, written

SAMPLE_ROWS = 20_000  # about so many vectors are fitted on
ROUNDS = 12
CANDIDATES = 10  # measured exactly, for each hit that is asked for
_SLICE = 1 << 21  # question-by-row cells worked on at a time
_TABLES = 256  # questions whose tables a task holds at a time


@dataclass(frozen=True)
class Book:
    """Cell centres (cells by width), and for each part its entries (parts by entries by step)."""

    middles: np.ndarray
    entries: np.ndarray

    @property
    def padded(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def parts(self, residuals: np.ndarray) -> np.ndarray:
        """Rows by parts by step; the last part is filled up with zeros."""
        room = np.zeros((len(residuals), self.padded))
        room[:, : residuals.shape[1]] = residuals
        return room.reshape(len(residuals), self.entries.shape[0], -1)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each vector."""
        cell = _gaps(vectors, self.middles).argmin(1)
        parts = self.parts(vectors - self.middles[cell])
        code = np.stack([_gaps(parts[:, j], e).argmin(1) for j, e in enumerate(self.entries)], 1)
        return cell, code.astype(np.uint8)

    def tables(self, questions: np.ndarray, cell: int) -> np.ndarray:
        """Squared distance of each part of each question to each entry, in a cell."""
        parts = self.parts(questions - self.middles[cell])
        return np.stack([_gaps(parts[:, j], e) ** 2 for j, e in enumerate(self.entries)], 1)


def _means(rows: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by Lloyd's rounds; one that loses its rows starts anew at the row farthest off."""
    middles = rows[rng.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        gap = _gaps(rows, middles)
        near = gap.argmin(1)
        far = gap[np.arange(len(rows)), near].argsort()[::-1]
        lost = iter(far)
        for c in range(len(middles)):
            mine = rows[near == c]
            middles[c] = mine.mean(0) if len(mine) else rows[next(lost)]
    return middles


def fit(
    collection: DataFrame, cells: int, parts: int = 16, entries: int = 256, id_col: str = "id",
    vector_col: str = "embedding", sample: int = SAMPLE_ROWS, seed: int = 7,
) -> Book:
    """Centres and books from about ``sample`` rows, chosen by a hash of the id and collected; rows
    without a finite vector take no part. At most 256 entries: a code is a byte for each part."""
    rows = collection.where(finite(vector_col))
    total = rows.count()
    if not total:
        raise ValueError("no vectors to fit on")
    drawn = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) / 1_000_000 < min(1.0, sample / total)
    held = sorted(tuple(r[0]) for r in rows.where(drawn).select(vector_col).collect())
    vectors = np.array(held or [rows.select(vector_col).first()[0]], dtype=np.float64)
    rng = np.random.default_rng(seed)
    middles = _means(vectors, cells, rng)
    step = -(-vectors.shape[1] // parts)
    blank = Book(middles, np.zeros((parts, 1, step)))
    residuals = blank.parts(vectors - middles[_gaps(vectors, middles).argmin(1)])
    count = min(entries, 256, len(vectors))
    return Book(middles, np.stack([_means(residuals[:, j], count, rng) for j in range(parts)]))


def build(
    collection: DataFrame, book: Book, path: str | None = None, id_col: str = "id", vector_col: str = "embedding"
) -> DataFrame:
    """The index of all rows with a finite vector: id, code, vector, and the cell that the written
    table is partitioned by."""
    spark = collection.sparkSession
    shared = spark.sparkContext.broadcast(book)
    kinds = dict(collection.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, `{vector_col}` {kinds[vector_col]}, code binary, cell int"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, vectors = _searchable(batch)
            if batch.num_rows:
                cell, code = shared.value.encode(vectors.astype(np.float64))
                flat = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, flat.cast(pa.binary()), pa.array(cell.astype(np.int32))], names=[id_col, vector_col, "code", "cell"]
                )

    rows = collection.select(id_col, vector_col).mapInArrow(task, schema)
    target = path or scratch_path(spark, "codes")
    rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(target)
    return spark.read.schema(rows.schema).parquet(target)


def _candidates(indexed: DataFrame, held: list, book: Book, probes: np.ndarray, k: int, id_col: str, schema: str) -> DataFrame:
    """The k rows of least table distance for each question and task, from the probed cells."""
    spark = indexed.sparkSession
    wanted = [int(c) for c in np.flatnonzero(probes.any(axis=0))]
    shared = spark.sparkContext.broadcast(([r[0] for r in held], np.array([r[1] for r in held], dtype=np.float64), book, probes))
    names = [f.name for f in StructType.fromDDL(schema)]
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, questions, book, probes = shared.value
        best = TopK(len(keys), k)
        last, tables = None, None
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if ids.dtype == object else ids
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            cells = batch.column(2).to_numpy()
            for cell in np.unique(cells).tolist():
                rows, probing = np.flatnonzero(cells == cell), np.flatnonzero(probes[:, cell])
                for first in range(0, len(probing), _TABLES):
                    mine = probing[first : first + _TABLES]
                    if (cell, first) != last:
                        last, tables = (cell, first), book.tables(questions[mine], cell)
                    step = max(1, _SLICE // len(mine))
                    for at in range(0, len(rows), step):
                        part = rows[at : at + step]
                        cost = tables[:, 0, codes[part, 0]]
                        for j in range(1, codes.shape[1]):
                            cost += tables[:, j, codes[part, j]]
                        limit = best.limit[mine]
                        if len(part) > k:
                            limit = np.minimum(limit, np.partition(cost, k - 1, axis=1)[:, k - 1])
                        q, r = np.nonzero(cost <= limit[:, None])
                        best.push(mine[q], cost[q, r], ids[part[r]])
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(best.columns(keys), types)], names=names)

    return indexed.where(F.col("cell").isin(wanted)).select(id_col, "code", "cell").mapInArrow(task, schema)


def search(
    indexed: DataFrame, book: Book, queries: DataFrame, k: int = C.DEFAULT_SEARCH_K, nprobe: int | None = None,
    candidates: int = CANDIDATES, id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """Nearly the k nearest rows of each question by squared L2: query id, rank, id, distance, score.
    Distances are exact; what may be missing are rows whose code puts them behind ``candidates``
    times k others, and those of cells other than the ``nprobe`` nearest, where that is given. Questions come in blocks within the broadcast
    bound; those without a finite vector take no part."""
    k = min(k, C.MAX_SEARCH_K)
    queries = written(queries.where(finite(query_vector)).select(query_id, query_vector), "questions")
    kinds = dict(indexed.dtypes) | {query_id: dict(queries.dtypes)[query_id]}
    schema = f"`{query_id}` {kinds[query_id]}, `{id_col}` {kinds[id_col]}, _near double"
    found = queries.sparkSession.createDataFrame([], schema)
    for held in query_blocks(queries, query_id, query_vector):
        gap = _gaps(np.array([r[1] for r in held], dtype=np.float64), book.middles)
        probes = np.zeros(gap.shape, dtype=bool)
        np.put_along_axis(probes, np.argsort(gap, axis=1, kind="stable")[:, :nprobe], True, axis=1)
        part = _candidates(indexed, held, book, probes, candidates * k, id_col, schema)
        found = found.unionByName(written(best_k(part, query_id, ["_near", id_col], candidates * k).select(query_id, id_col, "_near"), "near"))
    # Candidates are a bounded number for each question; their cells prune the scan of the vectors.
    near = found.select(query_id, id_col).join(queries, query_id)
    cells = sorted(r[0] for r in indexed.select(id_col, "cell").join(near.select(id_col), id_col, "left_semi").select("cell").distinct().collect())
    rows = indexed.where(F.col("cell").isin(cells)).select(id_col, vector_col)
    measured = rows.join(near, id_col).select(
        query_id, id_col, F.round(distance(F.col(vector_col), F.col(query_vector)), DECIMALS).alias("distance")
    )
    ranked = best_k(measured, query_id, ["distance", id_col], k)
    return ranked.withColumn("score", similarity("distance")).select(query_id, "rank", id_col, "distance", "score")
