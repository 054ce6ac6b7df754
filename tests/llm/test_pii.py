"""Spans of personal data against the plain patterns, and terms that disclose an entity."""

import math
import random
import re
from collections import Counter

import pytest

from corpusloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and checksum(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def checksum(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d if i % 2 == 0 else d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "Z", "@", ".", "-", "+", " ", "1", "25", "4111111111111111", "(", "é", "%", "\n"])
                       for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("4111-1111 1111 1111 x", "+1 (974) 555-3436.", "a@b.c@d.e", "1.2.3.256 01.002.3.4 1.2.3.4.5.6.7.8"):
        assert pii.base_spans(text) == plain(text)


def test_long_texts_cost_their_length():
    for text in ("1" * 300_000, "a" * 300_000 + "@b.c", "@" * 100_000, "a@b.c " * 20_000, " " * 300_000 + "a@b.c"):
        spans = pii.base_spans(text)
        pii._near_terms(text, spans, 5)
    assert len(pii.base_spans("a@b.c " * 20_000)) == 20_000


def rows_with_terms():
    """Four texts name an address together with one rare word; other words are everywhere."""
    rows = [(i, f"the of and number {i} it was", "en") for i in range(40)]
    rows += [(100 + i, f"the Zorblax of a@b.org and it {i} was", "en") for i in range(4)]
    rows += [(200, "Zorblax alone", "en"), (201, None, None), (202, "", "en"), (None, "x@y.z", "en"), (203, "zorblax", "en")]
    return rows + [rows[41]]


def test_disclosing_terms(spark):
    docs = spark.createDataFrame(rows_with_terms(), "doc_id long, text string, lang string")
    got = {}
    for r in pii.find(docs, generalise=0.7).collect():
        got.setdefault(r.doc_id, []).append((sorted(map(tuple, r.base)), sorted(map(tuple, r.added))))
    assert sum(map(len, got.values())) == len(rows_with_terms())
    assert got[101] == [([("email", 15, 22)], [("generalise", 4, 11)])] * 2
    assert got[200] == [([], [("generalise", 0, 7)])] and got[203] == [([], [("generalise", 0, 7)])]
    assert got[201] == got[202] == [([], [])] and got[None] == [([("email", 0, 5)], [])]
    assert all(got[i] == [([], [])] for i in range(40))
    clean = {(r.doc_id, r.text, r.lang) for r in pii.sanitise(docs, generalise=0.7).collect()}
    assert (101, "the [NAME] of [EMAIL] and it 1 was", "en") in clean
    assert (201, None, None) in clean and (3, "the of and number 3 it was", "en") in clean
    assert (203, "[WORD]", "en") in clean


def test_bits_left_unknown(spark):
    docs = spark.createDataFrame(rows_with_terms(), "doc_id long, text string, lang string")
    # Of six texts with the term four are with the entity, smoothed 3.94: 0.608 of 3.58 bits are left.
    assert any(r.added for r in pii.find(docs, generalise=0.62).collect())
    assert not any(r.added for r in pii.find(docs, generalise=0.6).collect())


def test_empty_table_and_other_columns(spark):
    schema = "doc_id long, text string, _digest string, kinds int"
    assert pii.find(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, "see a@b.org", "d", 3)], schema)
    assert [tuple(r) for r in pii.sanitise(docs).collect()] == [(1, "see [EMAIL]", "d", 3)]


def test_query_on_the_table(spark, sf_dir):
    import hashlib

    from corpusloom.llm.document_queries import op2_pii

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_pii(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r.doc_id] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in PATTERNS]
        assert r.spans.startswith(text)


def group_of(name):
    kind, value = name.split(":")
    cut = {"email": lambda: value[value.index("@"):], "ip": lambda: value[: value.rindex(".") + 1],
           "card": lambda: value[:6] + "*", "phone": lambda: value[:-4] + "*"}[kind]()
    return f"{kind}:{cut}"


def plain_added(texts, generalise, remove):
    """Spans added in each text, from counts over all pairs of an entity and a term."""
    texts = sorted(set(texts))
    near, having, words = Counter(), Counter(), Counter()
    for text in texts:
        spans = pii.base_spans(text)
        words.update({w.lower() for w in re.findall(r"[^\W_]+", text)})
        raised = lambda name: (name, group_of(name))
        having.update({e for k, a, b in spans for e in raised(pii._entity(k, text[a:b]))})
        near.update({(e, t) for name, t in pii._near_terms(text, spans, pii.REACH) for e in raised(name)})
    left = {}
    for (entity, term), n in near.items():
        unknown = math.log2(words[term] / (n - 2.0**-n))
        if math.log2(len(texts) / having[entity]) - unknown >= pii.MIN_BITS:
            left[term] = min(left.get(term, math.inf), unknown)
    out = {}
    for text in texts:
        base = pii.base_spans(text)
        out[text] = sorted(
            ("remove" if left[m[0].lower()] <= remove else "generalise", *m.span())
            for m in re.finditer(r"[^\W_]+", text) if left.get(m[0].lower(), math.inf) <= generalise
            and not any(a < m.end() and m.start() < b for _, a, b in base)
        )
    return out


@pytest.mark.parametrize("thresholds", [(pii.GENERALISE, pii.REMOVE), (1.2, 0.5)])
def test_added_spans_equal_all_pairs_counted(spark, sf_dir, thresholds):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9_000_000 + i, t) for i, t in enumerate(once())], docs.schema))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = plain_added(texts.values(), *thresholds)
    got = pii.find(docs, generalise=thresholds[0], remove=thresholds[1]).collect()
    assert all(sorted(map(tuple, r.added)) == want[texts[r.doc_id]] for r in got)
    assert sum(len(r.added) for r in got) == sum(len(want[t]) for t in texts.values()) > 0


def once():
    """Every value stands in one text only."""
    rows = [f"our plain text is at number {i} of the corpus" for i in range(200)]
    rows += [f"the Quuxcorp of u{i}@quux.org was number {i}" for i in range(6)]
    rows += [f"our Netzwort at 10.7.3.{i} was number {i}" for i in range(6)]
    rows += [f"our Rufwort is +49 30 1234 {5600 + i} of number {i}" for i in range(6)]
    rows += [f"the Twice of v{i}@w{i}.org was number {i}" for i in range(2)] + ["the Single of s@single.org was number 3"]
    return rows + ["Quuxcorp at last, netzwort and Rufwort, Twice, Single"]


def test_defaults_find_terms_by_group(spark):
    docs = spark.createDataFrame(list(enumerate(once())), "doc_id long, text string")

    def found(docs):
        return Counter(once()[r.doc_id][s["start"] : s["end"]].lower() for r in pii.find(docs).collect() for s in r.added)

    often = ["quuxcorp", "netzwort", "rufwort"]
    assert found(docs) == Counter(dict.fromkeys(often, 7))  # also where they stand alone
    assert found(docs.where("text NOT LIKE '%last%'")) == Counter(dict.fromkeys(often, 6))


def planted(texts):
    """Names beside values or domains that recur, and labels beside values of all sorts."""
    rows = [f"tel +49 {100 + i % 9}{i} 55{1000 + i} mail m{i}@d{i}.org of case n{i}x" for i in range(texts // 10)]
    rows += [f"Mister Zorbl{j} has zorbl{j}@firm{j}.org now" for j in range(5) for _ in range(4)]
    rows = [f"{r} in text t{i}t" for i, r in enumerate(rows)]
    return rows + [f"plain words of the corpus are number w{i}w" for i in range(texts - len(rows))]


def test_the_same_at_any_size_and_labels_stay(spark):
    """Recall and false rate of planted names at the defaults, for a corpus and one a hundred times
    as large; words that are in one text only never count as evidence."""
    for size in (400, 40_000):
        rows = planted(size)
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
        got = Counter((rows[r.doc_id][s["start"] : s["end"]].lower(), s["kind"]) for r in pii.find(docs).collect() for s in r.added)
        assert got == Counter({(f"zorbl{j}", "remove"): 4 for j in range(5)})


def test_number_of_added_spans_on_the_given_table(spark, sf_dir):
    """As many as pairs counted one by one give (README)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text or "" for r in docs.collect()]
    want = sum(len(plain_added(texts, pii.GENERALISE, pii.REMOVE)[t]) for t in set(texts))
    assert sum(len(r.added) for r in pii.find(docs).dropDuplicates(["_digest"]).collect()) == want


def test_words_beyond_a_list_of_entities_are_close():
    many = ", ".join(f"10.20.30.{i}" for i in range(40))
    text = f"Before one two three four five {many}, six seven eight nine ten Zorblax"
    pairs = pii._near_terms(text, pii.base_spans(text), 5)
    for i in (0, 20, 39):
        near = {t for e, t in pairs if e == f"ip:10.20.30.{i}"}
        assert near == set("one two three four five six seven eight nine ten".split())


def test_close_words_equal_all_free_words():
    rng = random.Random(2)
    for _ in range(300):
        text = " ".join(rng.choice(["a@b.org", "1.2.3.4", "4111111111111111", "+1 (974) 555-3436", "w" * rng.randrange(1, 400), "x", "y", "z", "-"])
                        for _ in range(rng.randrange(60)))
        spans = pii.base_spans(text)
        free = [m for m in re.finditer(r"[^\W_]+", text) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        want = set()
        for k, a, b in spans:
            near = [m for m in free if m.end() <= a][-3:] + [m for m in free if m.start() >= b][:3]
            want.update((pii._entity(k, text[a:b]), m[0]) for m in near)
        assert pii._near_terms(text, spans, 3) == want
