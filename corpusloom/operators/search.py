"""Exact and cell-pruned nearest-neighbour search over a vector table.

The collection is only ever scanned: each task holds the query block, keeps its own k best
rows per query, and only those are shuffled. Query sets above the broadcast bound are taken in
blocks, one scan each; the collection is never copied or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from corpusloom import constants as C
from corpusloom.functions.predicates import apply_filter
from corpusloom.functions.text import similarity
from corpusloom.functions.vectors import METRICS, Nearest, finite
from corpusloom.operators.joins import small_side
from corpusloom.session import scratch_path, written

# Bounds on what is sent to every task.
MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """List column as a matrix; vectors of unequal length are an error, not dropped."""
    if column.null_count:
        raise ValueError("null vector in search input")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // len(column) if len(column) else 0
    if len(column) and (width == 0 or not (pc.list_value_length(column).to_numpy() == width).all()):
        raise ValueError("vectors of unequal length in search input")
    return flat.reshape(len(column), width)


def _searchable(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of a batch whose vector, the last column, is there and finite, and their matrix. Tested
    here and not by a filter: above a vectorising function a filter would make it run twice."""
    batch = batch.filter(batch.column(batch.num_columns - 1).is_valid())
    if not batch.num_rows:
        return batch, np.zeros((0, 0))
    matrix = _matrix(batch.column(batch.num_columns - 1))  # null components are NaN
    good = np.isfinite(matrix).all(axis=1)
    return (batch, matrix) if good.all() else (batch.filter(pa.array(good)), matrix[good])


def query_blocks(queries: DataFrame, query_id: str, vector: str) -> Iterator[list]:
    """The query rows in blocks within the broadcast bounds, cut by a hash of the id. One block at
    a time is on the driver."""
    rows = queries.select(query_id, vector)
    count, width = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    most = max(1, min(MAX_BROADCAST_QUERIES, MAX_BROADCAST_BYTES // (8 * max(1, width or 1))))
    blocks = -(-count // most)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block) if blocks > 1 else rows
        held = part.collect()
        if held:
            yield held


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    """The results of all blocks. Each of several is written, so that the plan stays small and no
    more than one block has to be held for repeats."""
    if not parts:
        return empty
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def best_k(found: DataFrame, query_id: str, order: list[str], k: int) -> DataFrame:
    """Final k per query, ranked from 1. Large jobs merge in two steps, so that the partial
    results of very many tasks never meet in one task per query."""
    fan = min(256, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 32)
    if fan > 1:
        found = found.withColumn("_arm", F.pmod(F.xxhash64(order[-1]), F.lit(fan)))
        arm = Window.partitionBy(query_id, "_arm").orderBy(*order)
        found = found.withColumn("_at", F.row_number().over(arm)).where(F.col("_at") <= k)
        found = found.drop("_arm", "_at")
    whole = Window.partitionBy(query_id).orderBy(*order)
    return found.withColumn("rank", F.row_number().over(whole).cast("bigint")).where(F.col("rank") <= k)


def nearest(
    collection: DataFrame,
    queries: DataFrame,
    k: int = C.DEFAULT_SEARCH_K,
    metric: str = "l2",
    where: dict | None = None,
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """The k nearest rows of every query: query id, rank, id, distance, score, best first.

    The filter runs below the search and reaches the scan for top-level columns. Rows and queries
    whose vector is null or not finite take no part (:func:`unsearchable` counts them). Queries
    above the broadcast bound are searched in blocks, each by a scan of its own.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    k = min(k, C.MAX_SEARCH_K)
    rows = apply_filter(collection, where).select(F.col(id_col), F.col(vector_col))
    queries = queries.where(finite(query_vector))
    parts = []
    for held in query_blocks(queries, query_id, query_vector):
        part = _scan(rows, queries, held, k, metric, id_col, query_id)
        parts.append(written(part, "block") if len(held) >= MAX_BROADCAST_QUERIES // 2 else part)
    found = _union(parts, rows.sparkSession.createDataFrame([], _schema(rows, queries, id_col, query_id)))
    ranked = best_k(found, query_id, ["distance", id_col], k)
    return ranked.withColumn("score", similarity("distance")).select(
        query_id, "rank", id_col, "distance", "score"
    )


def unsearchable(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row: rows in all, and those whose vector is null or not finite."""
    return rows.agg(F.count("*").alias("rows"), F.count_if(~finite(vector_col)).alias("unsearchable"))


def _schema(rows: DataFrame, queries: DataFrame, id_col: str, query_id: str) -> str:
    kinds = dict(rows.dtypes) | {query_id: dict(queries.dtypes)[query_id]}
    return f"`{query_id}` {kinds[query_id]}, `{id_col}` {kinds[id_col]}, distance double"


def _scan(rows, queries, held, k, metric, id_col, query_id, probe=None) -> DataFrame:
    """Per task, the k best rows of every query. ``probe`` is (cell labels, queries by cells)
    and then the rows carry their cell between id and vector."""
    spark = rows.sparkSession
    schema = _schema(rows, queries, id_col, query_id)
    shared = spark.sparkContext.broadcast(
        ([r[0] for r in held], np.array([r[1] for r in held], dtype=np.float64), probe)
    )
    names = [query_id, id_col, "distance"]
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix, probe = shared.value
        best = Nearest(matrix, k, metric)
        for batch in batches:
            batch, vectors = _searchable(batch)
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if ids.dtype == object else ids
            allowed = None
            if probe is not None:
                cells, pairs = probe
                allowed = pairs[:, np.searchsorted(cells, batch.column(1).to_numpy())]
            best.add(ids, vectors, allowed)
        if best.ids is not None:
            arrays = [pa.array(c, type=t) for c, t in zip(best.columns(keys), types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(task, schema)


def label_means(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per label, aggregated in the JVM with map-side partial sums."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return vectors.groupBy(label).agg(vector_to_array(mean).alias("query_vector"))


def with_content(hits: DataFrame, collection: DataFrame, id_col: str = "id") -> DataFrame:
    """Put content and metadata on the hits, after the search, so that the search itself reads
    two columns only."""
    found, _ = small_side(hits, "hits")
    return collection.join(found, id_col)


# --- cells: an index written as a partitioned table ---------------------------------------------

def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of one matrix to all of another, by products."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _cell_of(middles: np.ndarray):
    def cells(vectors: pd.Series) -> pd.Series:
        return pd.Series(_gaps(np.stack(vectors.to_numpy()).astype(np.float64), middles).argmin(1).astype(np.int32))

    return cells


def build_cells(
    collection: DataFrame, cells: int | None = None, path: str | None = None,
    vector_col: str = "embedding", seed: int = 7, centres: list[list[float]] | None = None, share: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """(cell, centre, radius) and the collection with its ``cell``, written partitioned by it.

    Centres are fitted by k-means on all rows, or on a ``share`` of them that the caller names, or
    are given. Rows without a finite vector are left out.

    A search then reads only the cells that can matter. The rebalance hint lets adaptive
    execution split a cell that holds very many rows over several tasks and files.
    """
    spark = collection.sparkSession
    rows = collection.where(finite(vector_col))
    if centres is None:
        featured = rows.withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))
        train = featured.select("_v") if share >= 1.0 else featured.select("_v").sample(share, seed=seed)
        model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="_v", predictionCol="cell").fit(train)
        middles = np.array([c for c in model.clusterCenters()])
        indexed = model.transform(featured).drop("_v")
    else:
        middles = np.array(centres, dtype=np.float64)
        nearest_centre = F.pandas_udf(_cell_of(middles), "int")
        indexed = rows.withColumn("cell", nearest_centre(vector_col))
    target = path or scratch_path(spark, "cells")
    indexed.hint("rebalance", "cell").write.partitionBy("cell").parquet(target)
    stored = spark.read.schema(indexed.schema).parquet(target)
    shared = spark.sparkContext.broadcast(middles)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(len(shared.value), -1.0)
        for batch in batches:
            if batch.num_rows:
                cell = batch.column(0).to_numpy()
                gap = _matrix(batch.column(1)).astype(np.float64) - shared.value[cell]
                np.maximum.at(far, cell, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
        seen = np.nonzero(far >= 0)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(far[seen])], names=["cell", "radius"]
        )

    far = stored.select("cell", vector_col).mapInArrow(reach, "cell int, radius double")
    radius = dict(far.groupBy("cell").agg(F.max("radius")).collect())  # one row per cell
    centres = spark.createDataFrame(
        [(i, c.tolist(), radius.get(i, -1.0)) for i, c in enumerate(middles)],
        "cell int, centre array<double>, radius double",
    )
    return centres, stored


def nearest_in_cells(
    indexed: DataFrame,
    centres: DataFrame,
    queries: DataFrame,
    k: int = C.DEFAULT_SEARCH_K,
    nprobe: int = 8,
    exact: bool = False,
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """Squared-L2 search in the ``nprobe`` cells nearest to each query.

    With ``exact``, a second scan takes in every further cell that could still hold a nearer
    row: by the triangle inequality a cell of radius r cannot beat distance t when the query is
    farther than r + t from its centre. The result then equals a full search.
    """
    k = min(k, C.MAX_SEARCH_K)
    queries = queries.where(finite(query_vector))
    rows = indexed.select(id_col, "cell", vector_col)
    known = centres.orderBy("cell").collect()  # one row per cell, as many as the caller asked for
    label = np.array([r["cell"] for r in known])
    middle = np.array([r["centre"] for r in known], dtype=np.float64)
    radii = np.array([r["radius"] for r in known])
    parts = []
    for held in query_blocks(queries, query_id, query_vector):
        # Distances of one block of queries to the cells: bounded by the block.
        gap = _gaps(np.array([r[1] for r in held], dtype=np.float64), middle)
        near = np.argsort(gap, axis=1, kind="stable")[:, : min(nprobe, len(label))]
        pairs = np.zeros(gap.shape, dtype=bool)
        np.put_along_axis(pairs, near, True, axis=1)

        def probed(mask: np.ndarray) -> DataFrame:
            """Scan of the cells that any query probes: the cell filter prunes the index."""
            wanted = [int(c) for c in label[mask.any(axis=0)]]
            part = rows.where(F.col("cell").isin(wanted))
            return _scan(part, queries, held, k, "l2", id_col, query_id, (label, mask))

        found = probed(pairs)
        if exact:
            first = written(best_k(found, query_id, ["distance", id_col], k).drop("rank"), "cells")
            # At most k rows per query: bounded by the block and the cap on k.
            reach = {
                r[0]: np.sqrt(r[2]) if r[1] >= k else np.inf
                for r in first.groupBy(query_id).agg(F.count("*"), F.max("distance")).collect()
            }
            bound = np.array([reach.get(r[0], np.inf) for r in held])
            slack = 1e-6 * (1.0 + np.abs(gap))
            more = ~pairs & (radii >= 0) & (gap <= radii + bound[:, None] + slack)
            found = first.unionByName(probed(more)) if more.any() else first
        parts.append(written(found, "block") if len(held) >= MAX_BROADCAST_QUERIES // 2 else found)
    found = _union(parts, rows.sparkSession.createDataFrame([], _schema(rows, queries, id_col, query_id)))
    ranked = best_k(found, query_id, ["distance", id_col], k)
    return ranked.withColumn("score", similarity("distance")).select(
        query_id, "rank", id_col, "distance", "score"
    )
