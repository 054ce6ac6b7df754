"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts with the same set of word shingles form one node. The signatures of the nodes are cut into
trees; all trees together are one globally sorted table, in which a shared prefix is a run of
neighbours. Each entry looks at its neighbours from the longest shared prefix outwards, that is at
ever shorter prefixes, down to the depth at which the trees together reach the target recall at the
similarity threshold. Pairs whose signatures can't belong to similar sets are passed over. A run may
be longer than the neighbours looked at, or lie in several partitions: what is not connected by then
is compared in blocks of the run.

Candidates only say which nodes may belong together. Their components are verified whole: the
shingle sets of a component meet in blocks, and each pair of blocks counts the exact similarities of
all its pairs in the task, without ever writing the pairs down. So all links inside a component are
counted, also those that no tree found, and a group of very many near copies costs rows in
proportion to its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bits import bit_table, bits_for, has_bits
from corpusloom.llm.graph import components
from corpusloom.llm.wordbytes import chain, mix, slices, texts_of, word_hashes
from corpusloom.session import spread, written

WORDS = 5  # of a shingle
SIMILAR = Fraction(4, 5)
TREES, DEPTH = 16, 8
RECALL = 0.99
REACH = 8  # neighbours looked at on one side while a partition is read; the rest of a run comes after
RUN_BLOCK = 4096  # entries of a run
BLOCK = 512  # nodes
_CHUNK = 1 << 16
_A = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, TREES * DEPTH + 1001, dtype=np.uint64))


def depth_for(recall: float, similar: float, trees: int, depth: int) -> int:
    """The longest prefix at which some tree agrees with probability ``recall`` at least."""
    return next((d for d in range(depth, 1, -1) if 1 - (1 - similar**d) ** trees >= recall), 1)


def most_unequal_bits(similar: float, bits: int) -> int:
    """Unequal one-bit minima of two sets at the threshold: five deviations above the mean."""
    p = (1 - similar) / 2
    return math.ceil(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text. A text with fewer words than a
    shingle is one shingle; a text without words has none."""
    hashes, counts = word_hashes(*texts_of(column))
    grams = hashes
    for k in range(1, words):
        grams = chain(grams[:-1], hashes[k:]) if len(grams) > 1 else grams[:0]
    out, at = [], 0
    for count in counts.tolist():
        if count >= words:
            out.append(np.unique(grams[at : at + count - words + 1]))
        elif count:
            one = hashes[at : at + 1]
            for k in range(1, count):
                one = chain(one, hashes[at + k : at + k + 1])
            out.append(one)
        else:
            out.append(hashes[:0])
        at += count
    return out


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit value for each set, from its sum, its exclusive or and its size."""
    sums = np.array([np.add.reduce(keys) for keys in sets], dtype=np.uint64)
    others = np.array([np.bitwise_xor.reduce(mix(keys)) for keys in sets], dtype=np.uint64)
    return chain(sums, others ^ np.array([len(keys) for keys in sets], dtype=np.uint64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets."""
    out = np.empty((len(sets), len(_A)), dtype=np.uint32)
    start = 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + len(sets[stop]) <= _CHUNK):
            total += len(sets[stop])
            stop += 1
        keys = np.concatenate(sets[start:stop])
        sizes = np.array([len(s) for s in sets[start:stop]], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        for f in range(len(_A)):
            out[start:stop, f] = np.minimum.reduceat((keys * _A[f] + _B[f]) >> np.uint64(32), first)
        start = stop
    return out


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few megabytes of text (their second column)."""
    return (batch.slice(*part) for batch in batches for part in slices(batch.column(1)))


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        sets = shingle_sets(batch.column(1), words)
        some = [i for i, s in enumerate(sets) if len(s)]
        signs: list = [None] * len(sets)
        minima = signatures([sets[i] for i in some])
        for i, row in zip(some, (minima & 0xFFFF).astype(">u2")):
            signs[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), _longs(set_names(sets)), pa.array(signs, pa.binary())], names=["doc_id", "node", "sign"]
        )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node and tree: tree, path (its part of the signature), bits, node."""
    for batch in batches:
        n = batch.num_rows
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(n, TREES, 2 * DEPTH)
        low = signs.reshape(n, TREES * DEPTH, 2)[:, :, 1] & 1
        bits = np.packbits(low, axis=1)
        paths = pa.array([bytes(path) for path in signs.reshape(n * TREES, 2 * DEPTH)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), paths,
                pa.array([b for b in map(bytes, bits) for _ in range(TREES)], pa.binary()),
                pa.array(np.repeat(batch.column(0).to_numpy(), TREES)),
            ],
            names=["tree", "path", "bits", "node"],
        )


class _Sets:
    """Union-find over node numbers."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


_FOREST = "a long, b long, tree int, run binary, bits binary"


def _neighbours(batches: Iterator[pa.RecordBatch], depth: int, unequal: int) -> Iterator[pa.RecordBatch]:
    """From sorted entries: pairs (a, b) of nodes that may be similar and are not yet connected in
    this partition. Also, with b null, each entry with a partner in its run (a shared prefix of
    ``depth``) that it was not compared with: one farther away than the reach, or one that may lie
    in another partition, as the first and the last run may go on there."""
    sets, held, held_open, first = _Sets(), None, None, None
    schema = pa.schema([
        ("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("run", pa.binary()), ("bits", pa.binary()),
    ])

    def left_open(rows: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(at):
            rows = rows.take(pa.array(at))
            runs = [path[: 2 * depth] for path in rows["path"].to_pylist()]
            yield from pa.table({
                "a": rows["node"], "b": pa.nulls(len(at), pa.int64()), "tree": rows["tree"],
                "run": pa.array(runs, pa.binary()), "bits": rows["bits"],
            }).cast(schema).to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        carried = held.num_rows if held is not None else 0
        rows = pa.concat_tables([held, rows]) if carried else rows
        n = rows.num_rows
        tree = rows["tree"].to_numpy()
        node = rows["node"].to_numpy()
        path = np.frombuffer(b"".join(rows["path"].to_pylist()), dtype=">u2").reshape(n, -1)[:, :depth]
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), dtype=np.uint64).reshape(n, -1)
        pairs = []
        for offset in range(1, min(REACH, n - 1) + 1):
            same = (tree[offset:] == tree[:-offset]) & (path[offset:] == path[:-offset]).all(1)
            same[: max(0, carried - offset)] = False  # seen with the last batch
            at = np.flatnonzero(same)
            apart = np.bitwise_count(bits[at] ^ bits[at + offset]).sum(1)
            at = at[apart <= unequal]
            pairs += zip(node[at].tolist(), node[at + offset].tolist())
        new = [(a, b) for a, b in pairs if a != b and sets.join(a, b)]
        if new:
            none = pa.nulls(len(new))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in new]), pa.array([b for _, b in new]), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())],
                schema=schema,
            )
        if first is None:
            first = tree[0], path[0].copy()
        open_ = (tree == first[0]) & (path == first[1]).all(1)
        far = REACH + 1
        if n > far:
            same = (tree[far:] == tree[:-far]) & (path[far:] == path[:-far]).all(1)
            open_[far:] |= same
            open_[:-far] |= same
        told = np.zeros(n, dtype=bool)
        if carried:
            told[:carried] = held_open
        yield from left_open(rows, np.flatnonzero(open_ & ~told))
        keep = max(0, n - far)
        held, held_open = rows.slice(keep), (open_ | told)[keep:]
    if held is not None:
        # What is farther from the end of the last run than the reach has been told already.
        prefixes = [path[: 2 * depth] for path in held["path"].to_pylist()]
        trees = held["tree"].to_pylist()
        last = np.array([t == trees[-1] and p == prefixes[-1] for t, p in zip(trees, prefixes)])
        yield from left_open(held, np.flatnonzero(last & ~held_open))


def _close(rows: pa.Table, unequal: int) -> pa.Table:
    """Of a pair of blocks of one run: pairs of groups that hold nodes which may be similar, as few
    as connect them."""
    group, side = rows["group"].to_numpy(), rows["side"].to_numpy()
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), dtype=np.uint64).reshape(len(group), -1)
    same = rows["i"][0].as_py() == rows["j"][0].as_py()
    one = np.arange(len(group)) if same else np.flatnonzero(side == 0)
    two = one if same else np.flatnonzero(side == 1)
    sets, out = _Sets(), []
    if len(np.unique(group)) > 1:
        for start in range(0, len(one), 256):
            part = one[start : start + 256]
            apart = np.zeros((len(part), len(two)), dtype=np.uint16)
            for word in range(bits.shape[1]):
                apart += np.bitwise_count(bits[part, word][:, None] ^ bits[two, word][None])
            a, b = np.nonzero((apart <= unequal) & (group[part][:, None] != group[two][None]))
            found = np.unique(np.stack([group[part[a]], group[two[b]]], axis=1), axis=0)
            out += [(x, y) for x, y in found.tolist() if sets.join(x, y)]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def candidates(nodes: DataFrame, similar: float, recall: float, run_block: int = RUN_BLOCK) -> DataFrame:
    """(node, component) of the nodes (node, sign) that may be similar to another one: all pairs that
    share a prefix in some tree and whose bits allow it lie in one component.

    Neighbours within reach connect most of them. What they leave is settled without a limit: entries
    of a run that were not compared, and are not in one component already, meet in blocks of
    ``run_block``, so a run of any length is shared out among tasks.
    """
    depth, unequal = depth_for(recall, similar, TREES, DEPTH), most_unequal_bits(similar, TREES * DEPTH)
    entries = nodes.select("node", "sign").mapInArrow(_entries, "tree int, path binary, bits binary, node long")
    order = ["tree", "path", "node"]
    shuffles = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.repartitionByRange(shuffles, *order).sortWithinPartitions(*order)
    found = written(entries.mapInArrow(lambda b: _neighbours(b, depth, unequal), _FOREST), "forest")
    near = components(found.where("b IS NOT NULL").select("a", "b"))
    rest = found.where("b IS NULL").select("tree", "run", "bits", F.col("a").alias("node")).join(near, "node", "left")
    rest = written(rest.select("tree", "run", "bits", "node", F.coalesce("component", "node").alias("group")), "runs")
    runs = rest.groupBy("tree", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("group").alias("least"), F.max("group").alias("most")
    ).where("least < most").select("tree", "run", F.ceil(F.col("n") / run_block).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rest.join(runs, ["tree", "run"]).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.select("tree", "run", "bits", "group", "own", other).select(
        "tree", "run", "bits", "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    pairs = dealt.groupBy("tree", "run", "i", "j").applyInArrow(lambda rows: _close(rows, unequal), "a long, b long")
    joined = components(pairs).select(F.col("node").alias("group"), F.col("component").alias("whole"))
    known = near.join(joined, F.col("component") == F.col("group"), "left")
    known = known.select("node", F.coalesce("whole", "component").alias("component"))
    alone = joined.select(F.col("group").alias("node"), F.col("whole").alias("component"))
    return written(known.unionByName(alone.join(near.select("node"), "node", "left_anti")), "together")


def _own_key(node: int, key) -> bytes:
    return f"{node}:{'' if key is None else key}".encode()


def _wanted_sets(batches: Iterator[pa.RecordBatch], words: int, table: bytes) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        sets = shingle_sets(batch.column(1), words)
        names = set_names(sets).view(np.int64).tolist()
        keys = batch.column(0).to_pylist()
        rows = np.flatnonzero(has_bits([_own_key(n, k) for n, k in zip(names, keys)], table)).tolist()
        for i in range(0, len(rows), 500):
            part = rows[i : i + 500]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(part, pa.int64())), pa.array([names[r] for r in part], pa.int64()), pa.array([sets[r].tobytes() for r in part], pa.binary())],
                names=["doc_id", "node", "shingles"],
            )


def linked(first: list[np.ndarray], second: list[np.ndarray], similar: Fraction) -> np.ndarray:
    """Which sets of the first list are similar to which of the second: a boolean matrix."""
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (first, second)]
    keys = np.concatenate([*first, *second])
    owner = np.repeat(np.arange(len(first) + len(second)), np.concatenate(sizes))
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((len(first), len(second)), dtype=np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], (column[1:] != column[:-1]).astype(np.int64)]))
        width = 4096
        for low in range(0, int(column[-1]) + 1, width):
            i, j = np.searchsorted(column, [low, low + width])
            side = np.zeros((len(first) + len(second), min(width, int(column[j - 1]) - low + 1)), dtype=np.float32)
            side[owner[i:j], column[i:j] - low] = 1
            common += side[: len(first)] @ side[len(first) :].T
    common = common.astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None] - common
    return common * similar.denominator >= union * similar.numerator


def _verify(rows: pa.Table, similar: Fraction) -> pa.Table:
    """Of each node in a pair of blocks: the documents it links to there, and the least node it is
    connected with."""
    same = rows["i"][0].as_py() == rows["j"][0].as_py()
    node, copies, side = (rows[c].to_numpy() for c in ("node", "copies", "side"))
    sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in rows["shingles"]]
    one = np.arange(len(node)) if same else np.flatnonzero(side == 0)
    two = one if same else np.flatnonzero(side == 1)
    links = np.zeros(len(node), dtype=np.int64)
    least = node.copy()
    if len(one) and len(two):
        found = linked([sets[i] for i in one], [sets[i] for i in two], similar)
        if same:
            np.fill_diagonal(found, False)
        links[one] = found @ copies[two]
        if not same:
            links[two] += found.T @ copies[one]
        top = np.iinfo(np.int64).max
        while True:
            before = least.copy()
            least[one] = np.minimum(least[one], np.where(found, least[two][None], top).min(1))
            least[two] = np.minimum(least[two], np.where(found.T, least[one][None], top).min(1))
            if (before == least).all():
                break
    return pa.table({"node": node, "least": least, "links": links})


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similar: Fraction = SIMILAR,
    recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least key among the documents connected
    by links) and n_links (other documents of similarity ``similar`` or more).

    Words are lower-cased runs without white space. Equal shingle sets are links, too. Texts
    without words (null, empty) link to nothing: their class is their own key. Rows that share a
    key are documents of their own; null keys are passed over where others are in the class. An
    empty table gives no rows; further columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = spread(docs.select(F.col(key).alias("doc_id"), F.lower(text).alias("text")))
    signed = written(
        rows.mapInArrow(lambda b: _sign(b, words), f"doc_id {kind}, node long, sign binary"), "signed"
    )
    nodes = signed.where("sign IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least_doc"), F.count(F.lit(1)).alias("copies"), F.first("sign").alias("sign")
    )
    nodes = written(nodes, "nodes")
    # A node's set is taken from its least document.
    together = candidates(nodes, float(similar), recall)
    sizes = together.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = together.join(sizes, "component").join(nodes.select("node", "least_doc", "copies"), "node").select(
        "component", "node", "least_doc", "copies", F.ceil(F.col("n") / block).cast("int").alias("blocks")
    ).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    members = written(members, "members")
    own_key = F.concat_ws(":", F.col("node").cast("string"), F.coalesce(F.col("least_doc").cast("string"), F.lit("")))
    table = bit_table(members.select(own_key.alias("key")), bits_for(members.count()))
    sets = rows.mapInArrow(lambda b: _wanted_sets(b, words, table), f"doc_id {kind}, node long, shingles binary")
    sets = sets.join(members, "node").where(F.col("doc_id").eqNullSafe(F.col("least_doc"))).dropDuplicates(["node"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sets.select("component", "node", "copies", "shingles", "own", other).select(
        "component", "node", "copies", "shingles", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    checked = written(dealt.groupBy("component", "i", "j").applyInArrow(
        lambda group: _verify(group, similar), "node long, least long, links long"
    ), "checked")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(checked.select(F.col("node").alias("a"), F.col("least").alias("b")).where("a <> b"))
    known = nodes.select("node", "least_doc", "copies").join(links, "node", "left").join(joined, "node", "left").select(
        "node", "least_doc", F.coalesce("component", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    known = written(known, "classes")
    least = known.groupBy("component").agg(F.min("least_doc").alias("least"))
    known = known.join(least, "component").select(F.col("node").alias("_node"), "least", "links")
    return signed.join(known, (F.col("node") == F.col("_node")) & F.col("sign").isNotNull(), "left").select(
        "doc_id", F.when(F.col("sign").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, the one with the least key. Rows without words, and
    rows with a null key, stay as they are. Rows that share a key are judged by their texts: they
    are told apart unless these are equal, or of one class."""
    worded = F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)) & F.col(key).isNotNull()
    row = F.xxhash64(F.col(key), F.col(text))
    names = docs.where(worded).select(row.alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = written(classes(names, "_row", "_text", **options).select("doc_id", "class_id").distinct(), "kept")
    known = names.select("_row", "_key").distinct().join(found, F.col("_row") == F.col("doc_id"))
    kept = known.groupBy("class_id").agg(F.min_by("_row", F.struct("_key", "_row")).alias("_least")).select("_least")
    mark = "_row" + "_" * max(map(len, docs.columns))  # no column has that name
    rows = docs.where(worded).withColumn(mark, row)
    rows = rows.join(kept, rows[mark] == kept["_least"], "left_semi").dropDuplicates([mark]).drop(mark)
    return rows.unionByName(docs.where(~worded))
