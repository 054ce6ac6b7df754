"""Language identification by a convolutional network over bytes, trained here with numpy.

Bytes are embedded, filters of several widths slide over windows of fixed length, the largest
response of each filter goes through a rectifier into a softmax. All windows of a text are scored
and their log-probabilities averaged by bytes, so the whole text counts.

Training uses a bounded sample of labelled rows (``TRAIN_ROWS``, a parameter), dealt evenly to the
languages by a hash of the key. Applying it is a narrow operation. There, pairs of bytes are looked
up in tables of filter responses, which gives the same sums as the products of training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import spread

WINDOW = 128  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBEDDING = 8
TRAIN_ROWS = 2000  # about so many labelled rows are fitted on
CUTS = 4  # excerpts of a row in training
EPOCHS = 6
UNKNOWN = "und"
_CHUNK = 512  # windows scored at once


@dataclass
class Network:
    """Weights, by width where there is one; ``labels`` in the order of the outputs."""

    labels: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # (width, embedding, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(data: bytes) -> np.ndarray:
    """All windows of a text's bytes; the last one is filled up with zeros."""
    count = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(count * WINDOW, b"\0"), dtype=np.uint8).reshape(count, WINDOW)


def train(samples: list[tuple[bytes, str]], seed: int = 0, epochs: int = EPOCHS) -> Network:
    """Fit the network by Adam on windows of labelled samples."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for _, label in samples})
    known = {label: i for i, label in enumerate(labels)}
    cut = [(windows(data), known[label]) for data, label in samples]
    x = np.concatenate([w for w, _ in cut])
    y = np.concatenate([np.full(len(w), i) for w, i in cut])
    sizes = {w: WINDOW - w + 1 for w in WIDTHS}
    p = {"embed": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels)))}
    p |= {w: rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS}
    p |= {"bias": np.zeros(FILTERS * len(WIDTHS)), "out_bias": np.zeros(len(labels))}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            xb, yb, n = x[rows], y[rows], len(rows)
            emb = p["embed"][xb]
            columns, best, pooled = {}, {}, []
            for w in WIDTHS:
                col = np.concatenate([emb[:, j : j + sizes[w]] for j in range(w)], axis=2)
                response = col @ p[w]
                best[w] = response.argmax(1)
                columns[w] = col
                pooled.append(np.take_along_axis(response, best[w][:, None], 1)[:, 0])
            z = np.concatenate(pooled, 1) + p["bias"]
            hidden = np.maximum(z, 0)
            logits = hidden @ p["out"] + p["out_bias"]
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            d = prob
            d[np.arange(n), yb] -= 1
            d /= n
            g = {"out": hidden.T @ d, "out_bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
            dz = (d @ p["out"].T) * (z > 0)
            g["bias"] = dz.sum(0)
            for k, w in enumerate(WIDTHS):
                dw = dz[:, k * FILTERS : (k + 1) * FILTERS]
                at_best = np.take_along_axis(columns[w], best[w][:, :, None], 1)
                g[w] = np.einsum("bf,bfk->kf", dw, at_best)
                dcol = (dw[:, :, None] * p[w].T[None]).reshape(n, FILTERS, w, EMBEDDING)
                for j in range(w):
                    np.add.at(g["embed"], np.take_along_axis(xb, best[w] + j, 1), dcol[:, :, j])
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(
        labels, p["embed"].astype(np.float32),
        {w: p[w].reshape(w, EMBEDDING, FILTERS).astype(np.float32) for w in WIDTHS},
        p["bias"].astype(np.float32), p["out"].astype(np.float32), p["out_bias"].astype(np.float32),
    )


class Scorer:
    """Applies a network through tables of the responses to single bytes and pairs."""

    def __init__(self, net: Network):
        self.net = net
        self.tables = {}
        for w, filters in net.filters.items():
            single = [net.embed @ filters[j] for j in range(w)]
            parts = []
            for j in range(0, w - 1, 2):
                pair = (single[j][:, None] + single[j + 1][None]).reshape(65536, -1)
                parts.append((j, pair))
            self.tables[w] = parts, (single[w - 1] if w % 2 else None)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each label, for each window."""
        net, n = self.net, len(x)
        pairs = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
        pooled = []
        for w, (parts, last) in self.tables.items():
            size = WINDOW - w + 1
            total = None
            for j, table in parts:
                got = table.take(pairs[:, j : j + size].ravel(), axis=0, mode="clip")
                total = got if total is None else np.add(total, got, out=total)
            if last is not None:
                total += last.take(x[:, w - 1 : w - 1 + size].ravel(), axis=0, mode="clip")
            pooled.append(total.reshape(n, size, -1).max(1))
        hidden = np.maximum(np.concatenate(pooled, 1) + net.bias, 0)
        logits = (hidden @ net.out + net.out_bias).astype(np.float64)
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Label index and probability for each text."""
        cut = [windows(t) for t in texts]
        x = np.concatenate(cut)
        logp = np.concatenate([self.log_probabilities(x[i : i + _CHUNK]) for i in range(0, len(x), _CHUNK)])
        counts = np.array([len(c) for c in cut])
        weight = np.full(len(x), float(WINDOW))
        ends = counts.cumsum() - 1
        lengths = np.array([len(t) for t in texts])
        weight[ends] = np.maximum(lengths - (counts - 1) * WINDOW, 1)
        starts = ends - counts + 1
        mean = np.add.reduceat(logp * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        prob = np.exp(mean - mean.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        best = prob.argmax(1)
        return best, prob[np.arange(len(best)), best]


def training_sample(
    docs: DataFrame, key: str, text: str, lang: str, rows: int = TRAIN_ROWS
) -> list[tuple[bytes, str]]:
    """Excerpts of about ``rows`` labelled rows with letters, as many of each language where it
    has so many, chosen by a hash of the key. Collects that bounded sample."""
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    labelled = labelled.where(F.col("l").isNotNull() & has_letter(F.col("t")))
    counts = {r["l"]: r["count"] for r in labelled.groupBy("l").count().collect()}  # a row per language
    if not counts:
        return []
    want = max(1, rows // len(counts))
    share = F.create_map(*[F.lit(v) for l, n in counts.items() for v in (l, min(1.0, want / n))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "k", "t"), F.lit(1_000_000)) / 1_000_000
    room = F.greatest(F.length("t") - WINDOW, F.lit(1))
    cuts = [
        F.substr("t", (F.pmod(F.xxhash64(F.lit(i), "k"), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(CUTS)
    ]
    chosen = labelled.where(drawn < share[F.col("l")]).select("l", F.explode(F.array_distinct(F.array(*cuts))).alias("t"))
    return sorted((r["t"].encode(), r["l"]) for r in chosen.collect())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _apply(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(net) if net else None
    for batch in batches:
        keep, lettered = batch.columns[:-2], batch.column(batch.num_columns - 1).to_pylist()
        texts = batch.column(batch.num_columns - 2).cast(pa.binary())
        langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
        at = [i for i, yes in enumerate(lettered) if yes]
        for i in range(0, len(at), 256):
            rows = at[i : i + 256]
            best, prob = scorer.judge([texts[r].as_py() for r in rows])
            for r, b, p in zip(rows, best, prob):
                langs[r], scores[r] = net.labels[b], float(p)
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(langs), pa.array(scores, pa.float64())],
            names=[*batch.schema.names[:-2], "lang_pred", "score"],
        )


def predict(docs: DataFrame, net: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (0 to 1) of each row.

    Null texts and texts without a letter are ``und`` with score 0, as is everything where there
    was nothing to learn from. Only the text is looked at.
    """
    letters = has_letter(F.col(text)) if net else F.lit(False)
    rows = docs.select(*keep, F.col(text).alias("_text"), letters.alias("_letters"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return spread(rows).mapInArrow(partial(_apply, net=net), f"{schema}, lang_pred string, score double")


def fit(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, seed: int = 0
) -> Network | None:
    """A network from the labelled rows, or None where there are none."""
    samples = training_sample(docs, key, text, lang, rows)
    return train(samples, seed) if samples else None
