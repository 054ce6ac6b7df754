"""Nearest neighbours by collision counting on single projections.

Vectors, brought to unit length, are projected on random directions; per direction they stand in a
sorted array. A query opens a window around its own projection in every array and widens all of
them together (virtual rehashing: a wider window is a coarser hash centred at the query, from the
same array). A vector's collisions are the arrays in which it lies inside the window. Whoever
reaches the collision threshold is verified with the full vectors. A query ends when its windows
are as wide as the distance of its k-th verified vector: closer ones would have reached the
threshold with the wanted probability. Windows that cover everything make the search exact, so no
candidate is ever cut off.

The index is cut into shards by a hash of the id, the queries into blocks; each pair of a shard and
a block is one group of bounded size, and each group returns k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import written

PROJECTIONS = 64
WIDTH = 1.0  # half-width of the last window, in distances of the k-th vector
MARGIN = 2.0  # deviations by which a vector may stay below its mean of collisions
GROWTH = 1.25
SHARD_ROWS, BLOCK_ROWS = 20_000, 2048


def collision_threshold(projections: int, width: float, margin: float) -> int:
    """Collisions that a vector at the distance in question reaches almost surely."""
    p = math.erf(width / math.sqrt(2))
    return max(1, math.floor(projections * p - margin * math.sqrt(projections * p * (1 - p))))


class Index:
    """Sorted projections of unit vectors."""

    def __init__(self, vectors: np.ndarray, projections: int, seed: int):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.axes = np.random.default_rng(seed).normal(size=(vectors.shape[1], projections))
        values = (vectors / self.norms[:, None]) @ self.axes
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values.T, self.order, 1)

    def search(self, query: np.ndarray, norm: float, skip: np.ndarray, k: int, width: float, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Verified rows and their cosines. ``skip`` marks rows that take no part."""
        n, m = len(self.vectors), len(self.order)
        centre = (query / norm) @ self.axes
        low = np.array([np.searchsorted(self.sorted[i], centre[i]) for i in range(m)])
        high = low.copy()
        counts = np.zeros(n, dtype=np.int64)
        done = skip.copy()
        open_rows = n - int(skip.sum())
        rows, scores = [], []
        best = np.zeros(0)
        half = 0.05
        while True:
            new = []
            for i in range(m):
                values = self.sorted[i]
                a, b = np.searchsorted(values, centre[i] - half), np.searchsorted(values, centre[i] + half, side="right")
                new += [self.order[i, a : low[i]], self.order[i, high[i] : b]]
                low[i], high[i] = min(a, low[i]), max(b, high[i])
            counts += np.bincount(np.concatenate(new), minlength=n)
            found = np.flatnonzero((counts >= threshold) & ~done)
            if len(found):
                done[found] = True
                score = (self.vectors[found] * query).sum(1) / (self.norms[found] * norm)
                rows.append(found)
                scores.append(score)
                open_rows -= len(found)
                best = np.sort(np.concatenate([best, score]))[-k:]
            if open_rows <= 0:
                break
            if len(best) >= k and half >= width * math.sqrt(max(0.0, 2 - 2 * best[0])):
                break
            half *= GROWTH
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        return np.concatenate(rows), np.concatenate(scores)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _search(part: pa.Table, queries: pa.Table, k: int, projections: int, width: float, margin: float) -> pa.Table:
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if part.num_rows and queries.num_rows:
        part = part.sort_by("vec_id")  # ties go to the smaller id, and tasks can be repeated
        ids = part["vec_id"].combine_chunks()
        vectors = _matrix(part["vec"], part.num_rows)
        index = Index(vectors, projections, vectors.shape[1])
        threshold = collision_threshold(projections, width, margin)
        own = {v: i for i, v in enumerate(ids.to_pylist())}
        asked = _matrix(queries["vec"], queries.num_rows)
        norms = np.sqrt((asked * asked).sum(1))
        for i, query_id in enumerate(queries["vec_id"].to_pylist()):
            skip = np.zeros(len(vectors), dtype=bool)
            if query_id in own:
                skip[own[query_id]] = True
            rows, scores = index.search(asked[i], norms[i], skip, k, width, threshold)
            top = np.lexsort((rows, -scores))[:k]
            out["query_id"] += [query_id] * len(top)
            out["vec_id"] += ids.take(pa.array(rows[top])).to_pylist()
            out["score"] += scores[top].tolist()
    kind = part.schema.field("vec_id").type
    return pa.table({
        "query_id": pa.array(out["query_id"], kind), "vec_id": pa.array(out["vec_id"], kind),
        "score": pa.array(out["score"], pa.float64()),
    })


def usable(vec: Column) -> Column:
    """Not null, not empty, only finite components, not zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, odd) & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vec: str = "embedding",
    projections: int = PROJECTIONS, width: float = WIDTH, margin: float = MARGIN,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine in double precision) of the k nearest
    vectors found for each row of ``vectors`` for which ``is_query`` (a condition on the key) holds.

    The query itself is no candidate; fewer than k others give fewer rows; ties go to the smaller
    id. Vectors that are not :func:`usable`, and null ids, take no part; vectors of different
    lengths are not compared. Of rows that share an id, the least vector counts. Empty tables give
    no rows; further columns are ignored.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"), is_query.alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    # The scale of a vector does not matter; bring extreme ones where squares can be taken.
    most = F.array_max(F.transform("vec", F.abs))
    odd_scale = (most > 1e100) | (most < 1e-100)
    scaled = F.when(odd_scale, F.transform("vec", lambda x: x / most)).otherwise(F.col("vec"))
    rows = rows.groupBy("vec_id", "q").agg(F.min("vec").alias("vec")).withColumn("vec", scaled)
    rows = written(rows.withColumn("dim", F.size("vec")), "vectors")
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    shards, blocks = max(1, math.ceil(count["n"] / shard_rows)), max(1, math.ceil(count["q"] / block_rows))
    part = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    index = rows.select("dim", part(1, shards).alias("shard"), every(blocks).alias("block"), "vec_id", "vec")
    asked = rows.where("q").select("dim", every(shards).alias("shard"), part(2, blocks).alias("block"), "vec_id", "vec")
    group = ["dim", "shard", "block"]
    found = index.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(
        lambda some, queries: _search(some, queries, k, projections, width, margin),
        f"query_id {kind}, vec_id {kind}, score double",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
