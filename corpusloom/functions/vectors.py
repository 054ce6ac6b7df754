"""Vector expressions, and the block arithmetic that runs inside search tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "ip")
# Distances are compared at this many decimals, so that summation order cannot reorder ties.
DECIMALS = 9
_SLICE = 1 << 20  # query-by-row cells worked on at a time
_PAIRS = 1 << 14  # candidate pairs measured at a time


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def finite(vector: Column | str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Distance of two vector columns of one row: squared L2, cosine, or inner product."""
    if metric == "l2":
        squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0))
        return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    if metric == "cosine":
        return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    raise ValueError(f"metric must be one of {METRICS}")


def _ready(m: np.ndarray, metric: str) -> np.ndarray:
    m = np.ascontiguousarray(m, dtype=np.float64)
    if metric == "cosine":
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return m


class TopK:
    """Running k smallest (distance, id) of every query over the batches of one task."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.limit = np.full(queries, np.inf)
        self.q = np.empty(0, np.int64)
        self.d = np.empty(0, np.float64)
        self.ids: np.ndarray | None = None

    def push(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        q, d = np.concatenate([self.q, q]), np.concatenate([self.d, d])
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        order = np.lexsort((ids, d, q))
        q = q[order]
        first = np.searchsorted(q, q, side="left")
        order = order[np.arange(len(q)) - first < self.k]
        self.d, self.ids = d[order], ids[order]
        self.q = q[np.arange(len(q)) - first < self.k]
        count = np.bincount(self.q, minlength=len(self.limit))
        last = np.cumsum(count) - 1
        full = count == self.k
        self.limit[full] = self.d[last[full]]

    def columns(self, keys: list) -> list:
        ids = [] if self.ids is None else self.ids.tolist()
        return [[keys[i] for i in self.q], ids, self.d]


class Nearest(TopK):
    """Nearest rows by vector distance.

    Matrix products find candidates, with a margin for their rounding error; the candidates
    are then measured term by term. So the result is the exact top k, ordered by rounded
    distance and then id, whatever the batch boundaries are.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        super().__init__(len(queries), k)
        self.metric = metric
        self.queries = _ready(queries, metric)
        self.norms = np.einsum("ij,ij->i", self.queries, self.queries)

    def add(self, ids: np.ndarray, rows: np.ndarray, probe: np.ndarray | None = None) -> None:
        """Take in a batch; ``probe`` (queries by rows) limits which pairs count."""
        step = max(1, _SLICE // max(1, len(self.queries)))
        for at in range(0, len(rows), step):
            part = None if probe is None else probe[:, at : at + step]
            self._add(ids[at : at + step], _ready(rows[at : at + step], self.metric), part)

    def _add(self, ids: np.ndarray, rows: np.ndarray, probe: np.ndarray | None) -> None:
        rough = self.queries @ rows.T
        scale = 1.0
        if self.metric == "l2":
            norms = np.einsum("ij,ij->i", rows, rows)
            rough = self.norms[:, None] + norms[None, :] - 2.0 * rough
            scale += float(norms.max(initial=0.0) + self.norms.max(initial=0.0))
        else:
            rough = 1.0 - rough
        if probe is not None:
            rough = np.where(probe, rough, np.inf)
        margin = 10.0**-DECIMALS + 1e-12 * scale
        limit = self.limit
        if rough.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
        keep = rough <= (limit + margin)[:, None]
        if probe is not None:
            keep &= probe
        qi, ri = np.nonzero(keep)
        for at in range(0, len(qi), _PAIRS):
            q, r = qi[at : at + _PAIRS], ri[at : at + _PAIRS]
            self.push(q, self._measure(self.queries[q], rows[r]), ids[r])

    def _measure(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.metric == "l2":
            diff = a - b
            d = np.einsum("ij,ij->i", diff, diff)
        else:
            d = 1.0 - np.einsum("ij,ij->i", a, b)
        return np.round(d, DECIMALS) + 0.0
