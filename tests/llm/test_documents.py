"""Packing, language identification and sharding: round trips, held-out accuracy, laws."""

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import langid, packing, sharding
from corpusloom.llm.document_queries import TOKENIZER, op5_packing, op6_language_id, op8_sharding

SCHEMA = "doc_id long, text string, lang string, shard string, `start` int"
ODD = [
    (1, None, "en", "x", 1), (2, "", None, "x", 1), (3, "Héllo WORLD it's 12 <|endoftext|> ok", "fr", "x", 1),
    (4, "ΣΑΣ ﬁ \u0130 e\u0301 \x1c a\u00a0b", "de", "x", 1), (4, "same key", "en", "x", 1), (4, "same key", "en", "x", 1),
    (None, "no key", "en", "x", 1), (5, "long " * 20_000, "en", "x", 1), (6, " \n\t ", "en", "x", 1), (7, "!!! 123", "en", "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def full_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(pieces, texts, tokenizer, capacity=4096):
    """Every id of every document in one piece; sequences gapless and not too long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        copies = Counter((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in own)
        want = Counter()
        for text in texts[doc]:
            ids = np.array(full_ids(tokenizer, text), dtype="<u4")
            for s in range(0, len(ids), capacity):
                part = ids[s : s + capacity]
                want[s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
        assert copies == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return sum(p.length for p in pieces) / (capacity * len(by_sequence))


def test_packing_odd_texts(spark, odd, tokenizer):
    texts = defaultdict(list)
    for key, text, *_ in ODD:
        texts[key].append(text)
    check_packing(packing.pack_documents(odd, TOKENIZER).collect(), texts, tokenizer)
    rows = packing.pack_documents(odd, TOKENIZER, ids=True).where("doc_id = 5").orderBy("start").collect()
    assert [i for r in rows for i in r.ids] == full_ids(tokenizer, ODD[7][1])
    assert packing.pack_documents(odd.limit(0), TOKENIZER).count() == 0


def test_packing_the_table(spark, tokenizer):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: [r.text] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_packing(op5_packing(spark, sf_dir).collect(), texts, tokenizer) > 0.98


def test_words_equal_the_tokenizer(tokenizer):
    rng = random.Random(0)
    signs = ["a", "Ab", "'s", "'", "'ll", "é", "ß", "µ", "½", "12", "!", "?!", " ", "\n", "\x85", "\xa0", "<|", "œ", "Σ", "i\u0307", "\x1d", "ª"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(20)))
        ids = np.frombuffer(packing.token_bytes(text, TOKENIZER), dtype="<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_take_whole_texts(tmp_path):
    """A file with other normal forms, words or marks is not looked up in the table of words."""
    other = TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k")
    assert packing.has_these_words(TOKENIZER) and not packing.has_these_words(other)
    plain = Tokenizer.from_file(other)
    for text in ("Ab c\n d's 12", "", " Éa<|endoftext|>", "x" * 300):
        ids = np.frombuffer(packing.token_bytes(text, other), dtype="<u4").tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids
    with open(TOKENIZER, encoding="utf-8") as file:
        told = json.load(file)
    told["normalizer"]["normalizers"].pop()
    cased = str(tmp_path / "cased.json")
    with open(cased, "w", encoding="utf-8") as file:
        json.dump(told, file)
    assert not packing.has_these_words(cased)
    ids = np.frombuffer(packing.token_bytes("Ab ab", cased), dtype="<u4").tolist()
    assert ids == Tokenizer.from_file(cased).encode("Ab ab", add_special_tokens=False).ids


def test_first_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        items = sorted((rng.randrange(1, 101) for _ in range(rng.randrange(1, 80))), reverse=True)
        bins, free = [], []
        for n in items:
            at = next((i for i, f in enumerate(free) if f >= n), len(free))
            if at == len(free):
                free.append(100)
            bins.append((at, 100 - free[at]))
            free[at] -= n
        got = packing.first_fit_decreasing(items, 100)
        assert list(zip(*got)) == bins


def test_language_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_language_id(spark, sf_dir).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_of_odd_texts(spark, odd):
    rows = langid.predict(odd, langid.fit(odd), keep=("doc_id", "shard")).collect()
    assert len(rows) == len(ODD)
    und = [r for r in rows if r.lang_pred == "und"]
    assert sorted(r.doc_id for r in und) == [1, 2, 6, 7] and all(r.score == 0 for r in und)
    none = langid.predict(odd, langid.fit(odd.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.predict(odd.limit(0), None).count() == 0


def test_tables_equal_the_products():
    rng = np.random.default_rng(0)
    net = langid.train([(b"the cat sat on the mat " * 5, "a"), ("é è ç où " * 9).encode() and (b"zz yy xx " * 9, "b")], epochs=1)
    x = rng.integers(0, 256, (7, langid.WINDOW)).astype(np.uint8)
    pooled = []
    for w, filters in net.filters.items():
        total = sum(net.embed[x[:, j : langid.WINDOW - w + 1 + j]] @ filters[j] for j in range(w))
        pooled.append(total.max(1))
    z = np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert langid.Scorer(net).log_probabilities(x) == pytest.approx(want, abs=1e-4)


def check_shards(rows, shards):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, shards)
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))
    keys = defaultdict(set)
    for r in rows:
        keys[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in keys.values())
    return by_shard


def test_sharding_odd_texts(spark, odd, tmp_path):
    shuffled = sharding.external_shuffle(odd, shards=3, bucket_bytes=200)
    rows = shuffled.collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.lang, r.start) for r in rows))) == sorted(
        map(str, ((r[0], r[1], r[2], r[4]) for r in ODD))
    )
    check_shards(rows, 3)
    assert sharding.external_shuffle(odd.limit(0)).count() == 0
    sharding.write_shards(shuffled, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD) and {r.shard for r in rows} == {r.shard for r in back.collect()}


def test_sharding_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = op8_sharding(spark, sf_dir).collect()
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in rows)
    by_shard = check_shards(rows, 8)
    assert len(by_shard) == 8 and all(80 < len(s) < 180 for s in by_shard.values())
    assert 60 < sum(r.grown_shard == 8 for r in rows) < 170
    again = op8_sharding(spark, sf_dir).collect()
    assert {(r.doc_id, r.slot) for r in again} == {(r.doc_id, r.slot) for r in rows}
    inside = [r.doc_id for r in sorted(rows, key=lambda r: r.slot) if r.shard == 0]
    assert inside != sorted(inside)


def test_fisher_yates_is_even():
    rng = np.random.default_rng(0)
    seen = Counter(tuple(sharding.fisher_yates(3, rng)) for _ in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())
