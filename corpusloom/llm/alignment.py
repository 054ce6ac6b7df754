"""Alignment of two tokenizers' ids by the bytes that they share.

Both token sequences of a text cover the same bytes. Where tokens of both end, a group ends; every
stretch between neighbouring ends of either side lies in one token of each, and is one link. How
many documents hold a pair of ids linked is counted over the corpus, in two ways:

- A pair of equal bytes, as in every group of one token each, is known by its first id alone through
  a table from A ids to the B id of the same bytes. Its documents are counted in a vector as long as
  the vocabulary, one for each task.
- All other pairs are counted per block of documents first, and only these sums are shuffled by
  pair. The corpus-wide counts go back to the blocks that asked for them.

Texts are tokenized once. What a document needs to look its links up is written as short arrays.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.packing import _SIGNS
from corpusloom.llm.wordbytes import slices
from corpusloom.session import spread, written

LONG_TEXT = 1 << 18  # code points; a longer text goes to the other tokenizer, whose stack does not grow
# Fixed value: how byte-level tokenizers of this family cut a text into words.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_DOC, _PAIRS, _SAME = 0, 1, 2  # kinds of written rows


# --- the two tokenizers ---------------------------------------------------------------------------


def _rank_encoder(spec: dict, names: dict[str, int], spell: dict[str, bytes]):
    """A faster encoder of the same vocabulary where ids are the order of merging, else None."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    plain = (
        spec.get("normalizer") is None and model.get("type") == "BPE" and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not model.get("ignore_merges")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    )
    ordered = all(names.get(m) == 256 + i for i, m in enumerate(merged))
    singles = {spell[t] for t, i in names.items() if i < 256}
    if not (plain and ordered and len(names) == 256 + len(merged) and singles == {bytes([b]) for b in range(256)}):
        return None
    import tiktoken

    ranks = {spell[t]: i for t, i in names.items()}
    return tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """A (byte-level, a ``tokenizers`` file) and B (a ``sentencepiece`` model): ids of a text with a
    space in front, bytes of the ids, and for each A id the B id of the same bytes, or -1."""

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.byte = Tokenizer.from_file(byte_path)
        self.byte.encode_special_tokens = True  # their strings in a text are plain text
        self.piece = SentencePieceProcessor(model_file=piece_path)
        back = {sign: byte for byte, sign in _SIGNS.items()}
        with open(byte_path, encoding="utf-8") as file:
            spec = json.load(file)
        names = spec["model"]["vocab"]
        spell = {t: bytes(back[c] for c in t) for t in names}
        self.fast = _rank_encoder(spec, names, spell)
        self.a = [b""] * (1 + max([*names.values(), *(t["id"] for t in spec.get("added_tokens", []))]))
        for t, i in names.items():
            self.a[i] = spell[t]
        self.b = []
        for i in range(self.piece.get_piece_size()):
            name = self.piece.id_to_piece(i)
            byte = self.piece.is_byte(i)
            self.b.append(bytes([int(name[3:5], 16)]) if byte else name.replace("▁", " ").encode())
        known: dict[bytes, int] = {}
        for i in sorted(range(len(self.b)), key=lambda i: (self.piece.is_byte(i), i)):  # pieces before bytes
            if not (self.piece.is_control(i) or self.piece.is_unknown(i)):
                known.setdefault(self.b[i], i)
        self.same = np.array([known.get(t, -1) if t else -1 for t in self.a], dtype=np.int64)
        self.a_size = np.array([len(t) for t in self.a], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b], dtype=np.int64)
        self.digits, self.width = _decimals(max(len(self.a), len(self.b)))

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both, empty where there is no text or either does not spell it."""
        if not text:
            return [], []
        whole = " " + text
        if self.fast is not None and len(text) < LONG_TEXT:
            a = self.fast.encode_ordinary(whole)
        else:
            a = self.byte.encode(whole, add_special_tokens=False).ids
        b = self.piece.encode(text, num_threads=1)
        data = whole.encode()
        if b"".join(map(self.a.__getitem__, a)) != data or b"".join(map(self.b.__getitem__, b)) != data:
            return [], []
        return a, b


def _decimals(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to count - 1 as rows of bytes, and how many there are."""
    longest = len(str(max(0, count - 1)))
    text = np.array([str(i) for i in range(count)], dtype=f"S{longest}")
    return text.view(np.uint8).reshape(count, longest), np.char.str_len(text).astype(np.int64)


@lru_cache(maxsize=2)
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


# --- one part of a batch --------------------------------------------------------------------------


class Aligned:
    """Tokens of many texts, laid end to end. Both sides of a text have the same bytes, so offsets
    over all of them align both at once, and every text ends in a common end."""

    def __init__(self, both: Tokenizers, texts: list[str | None]):
        self.both = both
        ids = [both.encode(t) for t in texts]
        self.n_a, self.n_b = (np.array([len(x[i]) for x in ids], dtype=np.int64) for i in (0, 1))
        self.a, self.b = (np.array([t for x in ids for t in x[i]], dtype=np.int64) for i in (0, 1))
        self.end_a, self.end_b = np.cumsum(both.a_size[self.a]), np.cumsum(both.b_size[self.b])
        cuts = np.sort(np.concatenate([self.end_a, self.end_b]), kind="stable")
        self.cuts = cuts[np.diff(cuts, prepend=-1) > 0]
        self.common = cuts[:-1][cuts[:-1] == cuts[1:]] if len(cuts) else cuts
        at_a, at_b = np.searchsorted(self.end_a, self.cuts), np.searchsorted(self.end_b, self.cuts)
        doc_of_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.link_a, self.link_b = self.a[at_a], self.b[at_b]
        self.link_doc = doc_of_a[at_a]
        self.n_links = np.bincount(self.link_doc, minlength=len(texts))
        group_doc = doc_of_a[np.searchsorted(self.end_a, self.common)]
        self.n_groups = np.bincount(group_doc, minlength=len(texts))

    def digests(self) -> list[str]:
        """sha256 of each text's groups, written as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        upto_a = np.searchsorted(self.end_a, self.common, "right")
        upto_b = np.searchsorted(self.end_b, self.common, "right")
        group_a, group_b = np.searchsorted(self.common, self.end_a), np.searchsorted(self.common, self.end_b)
        before_b = np.concatenate([[0], upto_b])
        place_a = np.arange(len(self.a)) + before_b[group_a]
        place_b = np.arange(len(self.b)) + upto_a[group_b]
        ids, sign = np.zeros(len(self.a) + len(self.b), dtype=np.int64), np.zeros(len(self.a) + len(self.b), dtype=np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        sign[place_a] = np.where(self.common[group_a] == self.end_a, ord("|"), ord(","))
        sign[place_b] = np.where(self.common[group_b] == self.end_b, ord(";"), ord(","))
        width = self.both.width[ids]
        text = np.zeros((len(ids), self.both.digits.shape[1] + 1), dtype=np.uint8)
        text[:, :-1] = self.both.digits[ids]
        text[np.arange(len(ids)), width] = sign
        flat = memoryview(text[np.arange(text.shape[1])[None] <= width[:, None]].tobytes())
        ends = np.concatenate([[0], np.cumsum(width + 1)])[np.cumsum(self.n_a + self.n_b)].tolist()
        starts = [0, *ends[:-1]]
        return [hashlib.sha256(flat[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(starts, ends)]

    def counted(self) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """(text, A id, links) of pairs of equal bytes, and (text, pair, links) of all others, each
        different pair of a text once. A pair is the A id times the size of B plus the B id."""
        wide_a, wide_b = len(self.both.a), len(self.both.b)
        same = self.both.same[self.link_a] == self.link_b
        key, n = np.unique(self.link_doc[same] * wide_a + self.link_a[same], return_counts=True)
        pair = (self.link_doc * wide_a + self.link_a) * wide_b + self.link_b
        odd, m = np.unique(pair[~same], return_counts=True)
        return (key // wide_a, key % wide_a, n), (odd // (wide_a * wide_b), odd % (wide_a * wide_b), m)


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind)))


_COLUMNS = {
    "kind": "int", "block": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long",
    "groups_sha256": "string", "same": "array<int>", "same_n": "array<int>", "pair": "array<long>", "pair_n": "array<int>",
}


def _align(batches: Iterator[pa.RecordBatch], byte_path: str, piece_path: str) -> Iterator[pa.RecordBatch]:
    both = tokenizers(byte_path, piece_path)
    held = np.zeros(len(both.a), dtype=np.int64)
    block = (TaskContext.get().partitionId() << 32) - 1
    nothing = np.zeros(0, dtype=np.int64)
    kind_of_key = pa.int64()

    def rows(kind, keys, numbers, digests, same, pairs):
        """A batch of rows; ``numbers`` are n_a, n_b, n_groups, n_links."""
        count = len(keys)
        columns = [keys, pa.array([kind] * count, pa.int32()), pa.array([block] * count, pa.int64())]
        columns += [pa.array(n) for n in numbers] + [pa.array(digests, pa.string())]
        for (of, values, n), wide in ((same, np.int32), (pairs, np.int64)):
            sizes = np.bincount(of, minlength=count)
            columns += [_lists(values, sizes, wide), _lists(n, sizes, np.int32)]
        return pa.RecordBatch.from_arrays(columns, names=["_key", *_COLUMNS])

    zeros = [np.zeros(1, dtype=np.int64)] * 4
    empty = (nothing, nothing, nothing)
    for batch in batches:
        kind_of_key = batch.schema.field(0).type
        for start, count in slices(batch.column(1)):
            block += 1
            part = Aligned(both, batch.column(1).slice(start, count).to_pylist())
            same, odd = part.counted()
            held += np.bincount(same[1], minlength=len(held))
            numbers = (part.n_a, part.n_b, part.n_groups, part.n_links)
            yield rows(_DOC, batch.column(0).slice(start, count), numbers, part.digests(), same, odd)
            pair, n = np.unique(odd[1], return_counts=True)
            yield rows(_PAIRS, pa.nulls(1, kind_of_key), zeros, [None], empty, (np.zeros(len(pair), dtype=np.int64), pair, n))
    ids = np.flatnonzero(held)
    block = -1
    # Documents of a task that hold an id are fewer than 2^31.
    yield rows(_SAME, pa.nulls(1, kind_of_key), zeros, [None], (np.zeros(len(ids), dtype=np.int64), ids, held[ids]), empty)


# --- over the corpus ------------------------------------------------------------------------------


def _looked_up(docs: pa.Table, counts: pa.Table, shared, wide_b: int, columns: list[str]) -> pa.Table:
    """n_best and count_sum of the documents of a block, from the corpus-wide counts of its pairs."""
    held, best = shared.value
    docs = docs.combine_chunks()
    pair, total = counts["pair"].to_numpy(), counts["documents"].to_numpy()
    order = np.argsort(pair)
    pair, total = pair[order], total[order]
    n_best, count_sum = np.zeros(docs.num_rows, dtype=np.int64), np.zeros(docs.num_rows, dtype=np.int64)
    for name in ("same", "pair"):
        lists = docs[name].combine_chunks()
        values, n = lists.flatten().to_numpy(), docs[f"{name}_n"].combine_chunks().flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(docs.num_rows), lists.value_lengths().to_numpy())
        if name == "same":
            count, of = held[values], values
        else:
            count, of = total[np.searchsorted(pair, values)] if len(values) else n, values // wide_b
        np.add.at(count_sum, row, n * count)
        np.add.at(n_best, row, n * (count == best[of]))
    docs = docs.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
    return docs.select(columns)


def _vector(rows: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for at, n in rows.collect():  # one row per A id at most
        out[at] = n
    return out


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    Documents: the key of each row with n_a, n_b (tokens), n_groups, n_links, n_best (links whose
    pair is the most frequent of its A id, ties included), count_sum (counts of all links) and
    groups_sha256. Pairs: a, b, documents (that hold the pair linked), for every linked pair.

    Null and empty texts, and texts that either tokenizer does not spell byte for byte, have no
    tokens: zeros and an empty digest. Rows with one key, or one text, count each. An empty table
    gives no rows. Further columns are ignored. One text at a time is in memory whole, with some
    hundred bytes for each of its tokens. The vocabulary files must lie at the same place on all
    machines.
    """
    both = tokenizers(byte_path, piece_path)
    wide_a, wide_b = len(both.a), len(both.b)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, " + ", ".join(f"{n} {t}" for n, t in _COLUMNS.items())
    aligned = written(spread(rows).mapInArrow(partial(_align, byte_path=byte_path, piece_path=piece_path), schema), "aligned")

    same = aligned.where(F.col("kind") == _SAME).select(F.inline(F.arrays_zip("same", "same_n")).alias("a", "documents"))
    same = same.groupBy("a").agg(F.sum("documents").alias("documents"))
    held = _vector(same, wide_a)
    asked = aligned.where(F.col("kind") == _PAIRS).select("block", F.inline(F.arrays_zip("pair", "pair_n")).alias("pair", "n"))
    counts = written(asked.groupBy("pair").agg(F.sum("n").alias("documents")), "pair-counts")
    of_a = F.expr(f"pair div {wide_b}").alias("a")
    best = np.maximum(held, _vector(counts.groupBy(of_a).agg(F.max("documents")), wide_a))
    shared = spark.sparkContext.broadcast((held, best))

    answers = asked.select(F.col("block").alias("_asked"), "pair").join(counts, "pair")
    columns = ["_key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = aligned.where(F.col("kind") == _DOC).drop("kind").groupBy("block").cogroup(answers.groupBy("_asked")).applyInArrow(
        lambda left, right: _looked_up(left, right, shared, wide_b, columns),
        f"_key {kind}, " + ", ".join(f"{c} long" for c in columns[1:-1]) + ", groups_sha256 string",
    )
    equal = spark.createDataFrame([(a, int(b)) for a, b in enumerate(both.same) if b >= 0], "a long, b long")
    pairs = same.select(F.col("a").cast("long").alias("a"), "documents").join(F.broadcast(equal), "a").select("a", "b", "documents")
    odd = counts.select(of_a, F.expr(f"pair % {wide_b}").alias("b"), "documents")
    return found.withColumnRenamed("_key", key), pairs.unionByName(odd)
