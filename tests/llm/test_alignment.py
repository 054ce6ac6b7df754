"""Alignment of two tokenizers against a plain reading of all overlaps."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpusloom.llm import alignment
from corpusloom.llm.token_queries import BYTE_LEVEL, PIECES, op13_alignment

ODD = [
    (1, None, 0), (2, "", 0), (3, " ", 0), (4, "▁ is a space there", 0), (5, "Hello wörld, it's 12\n\n\tOK  x", 0),
    (6, "日本語のテキスト 🎉 \x00\x7f ﻿", 0), (7, "<|endoftext|> </s> <unk> <0x41> plain", 0), (8, "same words here", 0),
    (8, "same words here", 0), (None, "no key here", 0), (9, "word " * 60_000, 0), (10, "é" * 3000 + "\n" * 500, 0),
    (11, " leading and trailing  ", 0), (12, "a\r\nb c d　e", 0),
]
SCHEMA = "doc_id long, text string, block int"


@pytest.fixture(scope="module")
def plain():
    """(ids with their byte ranges) of both tokenizers, through their own offsets of bytes."""
    byte, piece = Tokenizer.from_file(BYTE_LEVEL), SentencePieceProcessor(model_file=PIECES)
    byte.encode_special_tokens = True
    both = alignment.tokenizers(BYTE_LEVEL, PIECES)

    def ranges(ids, spell):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(spell[i])))
            at += len(spell[i])
        return out

    def read(text):
        if not text:
            return [], []
        a, b = byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
        whole = (" " + text).encode()
        if b"".join(both.a[i] for i in a) != whole or b"".join(both.b[i] for i in b) != whole:
            return [], []
        return ranges(a, both.a), ranges(b, both.b)

    return read


def expected(texts, read):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    docs = []
    for text in texts:
        a, b = read(text)
        links, j = [], 0
        for i, start, stop in a:  # every overlap, by comparing ranges
            while j < len(b) and b[j][2] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][1] < stop:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        low, groups = 0, []
        for end in ends:
            side = lambda tokens: ",".join(str(i) for i, s, e in tokens if s >= low and e <= end)  # noqa: E731, B023
            groups.append((side(a), side(b)) if len(a) < 2000 else None)
            low = end
        docs.append((a, b, groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for a, b, groups, links in docs:
        text = ";".join(f"{x}|{y}" for x, y in groups) if groups and groups[0] else ""
        digest = hashlib.sha256(text.encode()).hexdigest() if text else "" if not a else None
        sums = sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)
        out.append((len(a), len(b), len(groups), len(links), *sums, digest))
    return out, count


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_odd_texts(spark, plain):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(5)
    found, pairs = alignment.align(docs, BYTE_LEVEL, PIECES)
    want, count = expected([r[1] for r in ODD], plain)
    got = sorted(((r.doc_id or 0), *[r[n] for n in NAMES]) for r in found.collect())
    want = sorted((k or 0, *w) for (k, *_), w in zip(ODD, want))
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and w[7] in (None, g[7])
    assert {(r.a, r.b): r.documents for r in pairs.collect()} == count
    assert pairs.count() == len(count)
    assert [r[1:] for r in got if r[0] in (1, 2, 4)] == [(0,) * 6 + ("",)] * 3
    none, no_pairs = alignment.align(docs.limit(0), BYTE_LEVEL, PIECES)
    assert none.count() == 0 and no_pairs.count() == 0


def test_the_query(spark, sf_dir, plain):
    rows = {r.doc_id: r for r in op13_alignment(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want, _ = expected([r.text for r in docs], plain)
    assert len(rows) == len(docs)
    for r, w in zip(docs, want):
        got = tuple(rows[r.doc_id][n] for n in NAMES)
        assert got[:6] == w[:6] and w[6] in (None, got[6])


def test_both_encoders_of_one_vocabulary():
    both = alignment.tokenizers(BYTE_LEVEL, PIECES)
    assert both.fast is not None
    rng = random.Random(3)
    signs = ["a", "The", "'s", "'", "é", "ß", "12", "!", "?!", " ", "  ", "\n", "\r\n", "\t", "\x85", "\xa0", "<|endoftext|>", "日本", "🎉", "́", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(25)))
        assert both.fast.encode_ordinary(text) == both.byte.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_vocabularies_go_the_slow_way(tmp_path):
    import json

    with open(BYTE_LEVEL, encoding="utf-8") as file:
        spec = json.load(file)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    assert alignment.Tokenizers(str(tmp_path / "other.json"), PIECES).fast is None
