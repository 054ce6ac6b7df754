"""Classes and links against all pairs compared."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

from corpusloom.llm import near
from corpusloom.llm.graph import components


def shingles(text, words=5):
    w = (text or "").lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def plain(rows):
    """class_id and n_links of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    links = [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted((str(k), str(k if not sets[i] else least.get(root(i))), links[i]) for i, (k, _) in enumerate(rows))


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, key = [], 0
    for size in [1] * 30 + [2, 3, 5, 40]:
        base = text(rng.randrange(6, 120))
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((key, " ".join(words)))
            key += 1
    long = " ".join(text(3000))
    rows += [(key + i, t) for i, t in enumerate([None, "", "  \n", "a b", "A  b", "a", long, long + " x", long, "a b c d e"])]
    return rows


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    rows += [(None, rows[0][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    for block in (512, 7):
        got = near.classes(docs, block=block).collect()
        assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == plain(rows)


def test_deduplicate_keeps_one_of_each_class(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    got = near.deduplicate(docs)
    assert got.columns == docs.columns
    want = {c for _, c, _ in plain(rows)}
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(want)


def test_repeated_keys_are_judged_by_their_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(1, text), (1, other), (1, text), (2, text + " end"), (3, "lone words here"), (3, "lone words here"), (4, " "), (4, " "),
            (5, None), (None, text), (6, other + " end"), (7, "w0 alone")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _least string")
    got = sorted(((str(r.doc_id), r.text) for r in near.deduplicate(docs).collect()), key=str)
    want = [("1", text), ("1", other), ("3", "lone words here"), ("4", " "), ("4", " "), ("5", None), ("None", text), ("7", "w0 alone")]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near.classes(docs).count() == 0 and near.deduplicate(docs).count() == 0


def test_recall_of_the_forest(spark):
    """Pairs just above the threshold are found about as often as promised."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = [f"{i}x{rng.random()}" for _ in range(104)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:100 - 7], *[f"y{i}{j}" for j in range(4)]]))]
        rows[-1] = (2 * i + 1, " ".join([*words[4:], *[]]) if i % 2 else " ".join(words[:92]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near.classes(docs).collect()}
    similar = [i for i in range(400) if 5 * len(shingles(rows[2 * i][1]) & shingles(rows[2 * i + 1][1])) >= 4 * len(shingles(rows[2 * i][1]) | shingles(rows[2 * i + 1][1]))]
    assert len(similar) > 150
    assert sum(got[2 * i + 1] == 2 * i for i in similar) >= 0.98 * len(similar)


def test_crowded_runs_lose_no_pair(spark):
    """Twins that share a prefix with hundreds of others in one tree only, and lie far apart there,
    are found wherever the partitions end and however the run is cut; the others stay alone."""
    rng = np.random.default_rng(1)
    width = near.TREES * near.DEPTH
    signs, twins = [], set()
    for size, planted in ((700, 40), (11, 3), (10, 1), (2, 1)):
        head = rng.integers(0, 1 << 16, 6)
        run = rng.integers(0, 1 << 16, (size, width))
        for i in range(planted):  # equal bits, other minima
            run[size - 1 - i] = run[i] ^ (rng.integers(1, 1 << 15, width) << 1)
            twins.add((len(signs) + i, len(signs) + size - 1 - i))
        run[:, :6] = head
        signs += run.tolist()
    rows = [(i, bytearray(np.array(s, dtype=">u2").tobytes())) for i, s in enumerate(signs)]
    nodes = spark.createDataFrame(rows, "node long, sign binary")
    for block in (near.RUN_BLOCK, 64):
        got = {}
        for r in near.candidates(nodes, 0.8, 0.99, block).collect():
            got.setdefault(r.component, []).append(r.node)
        assert {tuple(sorted(g)) for g in got.values()} == twins


def test_depth():
    d = near.depth_for(0.99, 0.8, 16, 8)
    assert 1 - (1 - 0.8**d) ** 16 >= 0.99 > 1 - (1 - 0.8 ** (d + 1)) ** 16


def test_linked_equals_sets():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(40, 60)], rng.integers(0, 99, 3, dtype=np.uint64)])) for _ in range(30)]
    sets.append(np.zeros(0, dtype=np.uint64))
    got = near.linked(sets, sets, Fraction(4, 5))
    for i, a in enumerate(sets[:-1]):
        for j, b in enumerate(sets[:-1]):
            a_, b_ = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (5 * len(a_ & b_) >= 4 * len(a_ | b_))


def test_shingle_sets_of_short_texts():
    sets = near.shingle_sets(pa.array(["a b", "a b", "b a", "", None, "a b c d e f"]), 5)
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0, 2]
    assert sets[0][0] == sets[1][0] != sets[2][0]


def test_components(spark):
    rng = random.Random(5)
    ids = [rng.getrandbits(62) for _ in range(300)]
    path = list(zip(ids[:200], ids[1:200])) + [(ids[250], ids[260]), (ids[260], ids[250]), (ids[270], ids[270])]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert len(got) == 202 and {got[i] for i in ids[:200]} == {min(ids[:200])}
    assert got[ids[250]] == got[ids[260]]
