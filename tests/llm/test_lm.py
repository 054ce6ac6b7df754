"""The scores against a model of plain dictionaries."""

import math
import re
from collections import Counter

import pytest

from corpusloom.llm import lm

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, order, prior):
    cut = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)), "</s>"] for _, t, _ in rows]
    grams = {k: Counter() for k in range(1, order + 1)}
    for words, (_, _, held) in zip(cut, rows):
        if not held:
            for k in grams:
                for i in range(max(1, k - 1), len(words)):
                    grams[k][tuple(words[i - k + 1 : i + 1])] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    starts = grams[1][("</s>",)]

    def chance(context, word):
        if not context:
            return (grams[1][(word,)] + 0.1) / (n + 0.1 * (v + 1))
        seen = starts if context == ("<s>",) else grams[len(context)][context]
        return (grams[len(context) + 1][(*context, word)] + prior * chance(context[1:], word)) / (seen + prior)

    out = []
    for words in cut:
        known = sum(grams[1][(w,)] > 0 for w in words[1:])
        base = sum(math.log10(chance((), w)) for w in words[1:])
        full = sum(
            math.log10(chance(tuple(words[max(0, i - order + 1) : i]), words[i])) for i in range(1, len(words))
        )
        out.append((len(words) - 1, known, n, base, full))
    return out


ROWS = [
    (1, "a b a b c", False), (2, "A b\ta  b", False), (3, None, False), (4, "", True), (5, "b c d zz a b", True),
    (5, "b c d zz a b", True), (None, "é a\x0bb", False), (7, "x " * 3000, False), (8, "y" * 70000, True),
]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("bucket_bytes", [100, 1 << 20])
def test_scores(spark, order, bucket_bytes):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, held_out boolean, n_known string")
    got = lm.score(docs, order=order, prior=2.0, bucket_bytes=bucket_bytes, range_bytes=500).collect()
    want = [(r[0], *w) for r, w in zip(ROWS, plain(ROWS, order, 2.0))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:])


def test_empty_tables(spark):
    schema = "doc_id long, text string, held_out boolean"
    assert lm.score(spark.createDataFrame([], schema)).count() == 0
    row = lm.score(spark.createDataFrame([(1, "a b", True)], schema)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_each_table_query(spark, sf_dir):
    from corpusloom.llm.document_queries import op3_lm_score, remainder

    got = {r.doc_id: r for r in op3_lm_score(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", remainder("doc_id", 10) == 0).collect()]
    for (doc, _, held), want in zip(rows, plain(rows, lm.ORDER, lm.PRIOR)):
        row = got[doc]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held, *want[:3])
        assert (row.base_score, row.score) == pytest.approx(want[3:])
