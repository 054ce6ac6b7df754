"""Packing of tokenized documents into sequences of fixed length.

Documents are cut into full pieces and a rest; pieces go to randomised groups of bounded size, and
each group is packed on its own by first-fit decreasing. A tournament tree over the free space of
the bins finds the first bin that fits in logarithmic time. Only the few numbers of a piece are
shuffled, never its tokens.

Tokenizing keeps a table of words in each Python worker: the pre-tokenizer splits a text into words
whose tokens do not depend on their neighbours, so most words are looked up. Texts for which that
is not certain go through the tokenizer as a whole, and so do all texts where the tokenizer's file
describes other normal forms or other words.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import spread, written

CAPACITY = 4096
GROUP_TOKENS = 8 << 20
_KNOWN_WORDS = 400_000  # table entries per worker; the table starts anew when it is full
# The words of the pre-tokenizer, which applies them to lower-cased text.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The letters and numbers of Latin-1, lower-cased.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(_WORDS.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS))
# Outside Latin-1 normal forms and case depend on context; the separators are space to some
# libraries only; special tokens are spelled with "<|".
_UNSURE = re.compile(r"[^\x00-\xff]|[\x1c-\x1f]|<\|")


# The steps of a tokenizer whose words may be looked up.
_NORMAL_FORMS = ["NFC", "Replace", "Lowercase"]
_SPLIT = {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in the vocabulary: itself where it is printable, else
    the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


_SIGNS = _byte_signs()


class _Words(dict):
    """Token ids of words as little-endian bytes. A word goes straight to the merges: it is lower
    case already, and one word to the pre-tokenizer."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        signs = word.encode().decode("latin-1").translate(_SIGNS)
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(signs)], dtype="<u4").tobytes()
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = ids
        return ids


def has_these_words(path: str) -> bool:
    """Whether the words of this module are those of the tokenizer in a file."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    forms = (told.get("normalizer") or {}).get("normalizers", [])
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    spaces = [f for f in forms if f["type"] == "Replace"] == [
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    ]
    signs = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    marked = all("<|" in token["content"] for token in told.get("added_tokens", []))
    return (
        [f["type"] for f in forms] == _NORMAL_FORMS and spaces and signs and steps[0] == _SPLIT
        and marked and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
    )


@lru_cache(maxsize=2)
def _words(path: str) -> tuple[_Words, bool]:
    from tokenizers import Tokenizer

    return _Words(Tokenizer.from_file(path)), has_these_words(path)


def token_bytes(text: str, path: str) -> bytes:
    """The ids of a text, four little-endian bytes each."""
    words, known = _words(path)
    if not known or _UNSURE.search(text):
        ids = words.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()
    return b"".join(map(words.__getitem__, _WORD.findall(text.lower())))


def _cut(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int, ids: bool) -> Iterator[pa.RecordBatch]:
    tail = np.array([end], dtype="<u4").tobytes()
    for batch in batches:
        docs, starts, lengths, sums, totals, parts = [], [], [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            tokens = memoryview(token_bytes(text.as_py() or "", path) + tail)
            count = len(tokens) // 4
            for start in range(0, count, capacity):
                piece = tokens[4 * start : 4 * (start + capacity)]
                docs.append(key)
                starts.append(start)
                lengths.append(len(piece) // 4)
                sums.append(zlib.crc32(piece))
                totals.append(count)
                if ids:
                    parts.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
        out = {
            "doc_id": pa.array(docs, batch.schema.field(0).type),
            "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()),
            "ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": pa.array(totals, pa.int64()),
        }
        if ids:
            out["ids"] = pa.array(parts, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict(out)


def cut_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = 2,
    capacity: int = CAPACITY, ids: bool = False,
) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: doc_id, start, length, ids_crc32,
    doc_tokens, and the ids themselves if asked for. Each document ends with the token ``end``;
    a null text has that token alone."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    work = partial(_cut, path=path, end=end, capacity=capacity, ids=ids)
    return spread(docs.select(key, text)).mapInArrow(work, schema)


class BinTree:
    """A tournament tree over bins: each node has the largest free space below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put an item into the first bin with room: the bin, and the space that was free there."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bin_, room = node - self.leaves, free[node]
        free[node] = room - size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return bin_, room


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item of a list in falling order."""
    tree = BinTree(len(lengths), capacity)
    placed = [tree.place(n) for n in lengths]
    return [b for b, _ in placed], [capacity - room for _, room in placed]


def _pack(rows: pa.Table, capacity: int, columns: list[str]) -> pa.Table:
    rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
    bins, offsets = first_fit_decreasing(rows["length"].to_pylist(), capacity)
    group = rows["_group"][0].as_py() << 32
    rows = rows.append_column("sequence_id", pa.array([group + b for b in bins], pa.int64()))
    return rows.append_column("offset", pa.array(offsets, pa.int64())).select(columns)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, seed: int = 0) -> DataFrame:
    """The pieces with sequence_id and offset.

    Groups are dealt by a seeded hash of document and start, so one long document spreads over
    all of them; their number follows the tokens, their size does not grow. Each group leaves at
    most its last bins unfilled.
    """
    pieces = written(pieces, "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(total / group_tokens))
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start"), F.lit(groups))
    columns = [*pieces.columns, "sequence_id", "offset"]
    schema = ", ".join(f"{c} {t}" for c, t in [*pieces.dtypes, ("sequence_id", "long"), ("offset", "long")])
    rows = pieces.withColumn("_group", group)
    return rows.groupBy("_group").applyInArrow(lambda group: _pack(group, capacity, columns), schema)


def pack_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = 2,
    capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, ids: bool = False,
) -> DataFrame:
    """Tokenize, cut and pack: one row per piece.

    Empty and null texts give one piece of one token. Rows with one key are packed each. An empty
    table gives no rows; further columns are ignored. A sequence shorter than ``capacity`` is to
    be padded up to it.
    """
    return pack(cut_tokens(docs, path, key, text, end, capacity, ids), capacity, group_tokens)
