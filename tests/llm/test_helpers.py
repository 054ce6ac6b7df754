"""Word hashes, bit tables and the spread of heavy inputs."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import wordbytes
from corpusloom.llm.bits import bit_table, bits_for, has_bits

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_word_hashes_tell_words_apart(monkeypatch):
    rng = random.Random(0)
    signs = ["a", "B", "é", " ", "\n", "\x0b", "\x1f", "x" * 50, "word"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(2000)] + [None, "", "z" * 5000]
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)) for t in texts]
    for block in (1 << 19, 64):
        monkeypatch.setattr(wordbytes, "_BLOCK", block)
        hashes, counts = wordbytes.word_hashes(*wordbytes.texts_of(pa.array(texts)))
        assert counts.tolist() == [len(w) for w in words]
        seen = {}
        for word, value in zip((w for ws in words for w in ws), hashes.tolist()):
            assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)
    sliced = pa.array(texts).slice(3, 50)
    again, counts = wordbytes.word_hashes(*wordbytes.texts_of(sliced))
    assert counts.tolist() == [len(w) for w in words[3:53]]
    assert again.tolist() == [seen[w] for ws in words[3:53] for w in ws]


def test_bit_table_lets_its_keys_through(spark):
    keys = [f"key {i}" for i in range(3000)]
    table = bit_table(spark.createDataFrame([(k,) for k in keys], "key string"), bits_for(3000))
    assert has_bits([k.encode() for k in keys], table).all()
    others = has_bits([f"other {i}".encode() for i in range(10_000)], table)
    assert others.mean() < 0.05
    empty = bit_table(spark.createDataFrame([], "key string"), bits_for(0))
    assert not has_bits([b"x"], empty).any() and len(has_bits([], empty)) == 0


def test_near_copies_in_one_large_group(spark):
    """Every link of a large group is counted, and the group comes out as one class."""
    from corpusloom.llm import near

    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: 180 + i % 20], f"own{i}"])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.classes(docs, block=128).agg(F.count_distinct("class_id"), F.min("n_links"), F.max("n_links")).first()
    assert tuple(got) == (1, 699, 699)


def test_mix_is_one_to_one():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(wordbytes.mix(x))) == len(x)
