"""Sanitisation of personal data by information content.

Patterns find the protected entities: mail and network addresses, card and phone numbers. Other
words may give an entity away, too. How much a term reveals an entity is their pointwise mutual
information over the corpus: the information content of the entity less what remains unknown of it
where the term is seen. Both are in bits, from the numbers of distinct texts with the entity, with
the term, and with the term close to the entity. Terms that leave no more than a fraction of a bit
unknown are generalised to their kind, those that leave still less are removed, wherever they occur.

What remains unknown, -log2 of the share of a term's texts in which it is close to the entity, does
not depend on the size of the corpus. Small counts are smoothed: a term in a single text leaves one
bit, one in two texts a fifth of a bit, so a single text never suffices, at any size. An entity that
most texts have holds no information to disclose.

Most values are in one text only, so evidence is also taken for the group of a value (mail domain,
network, card issuer, all but the last digits of a phone number). Each is an entity of its own, and
the most disclosed one counts. The kind of a value is none: a label such as the word before a phone
number tells that there is a number, but not whose.

Only terms within a few words of an entity can become candidates, and each text counts a pair once,
so pairs grow with the entities found, not with the square of anything; copies of one text count
once. Candidates are looked for in all texts through a bit table of bounded size, which is broadcast;
what it lets through is then joined with the candidates themselves.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bits import bit_table, bits_for, has_bits
from corpusloom.operators.joins import lookup_join
from corpusloom.session import spread, written

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")
REACH = 5  # words on either side of an entity
TAIL = 4  # last digits of a phone number that its group leaves out
ISSUER = 6  # first digits of a card number
GENERALISE, REMOVE = 0.25, 0.1  # bits of the entity that a term may leave unknown
MIN_BITS = 1.0  # of the entity's information that a term must give

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# Where a run of digits fails from its start it fails from within, so only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
_STEP = 256
_PLACES = 20_000  # places given out at once
_KNOWN_WORDS = 200_000  # words looked up by a task; it starts anew beyond


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From one @ to the next: the local part is all that may stand before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > end:  # backwards in steps, so that a long run costs its length
            part = _LOCAL.search(text, max(end, low - _STEP), low)
            if part.start() == low:
                break
            low = part.start()
        domain = _DOMAIN.match(text, at + 1) if low < at else None
        if domain:
            yield low, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches by kind, then start: leftmost, not overlapping within a kind; matches that
    fail their check are dropped."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _entity(kind: str, text: str) -> str:
    """One spelling of an entity."""
    return f"{kind}:{text.lower() if kind in ('email', 'ip') else _digits(text)}"


def _outer_words(text: str, low: int, high: int, reach: int) -> list[tuple[int, int, str]]:
    """The first and the last ``reach`` words between two places."""
    words = list(islice(_TERM.finditer(text, low, high), 2 * reach + 1))
    if len(words) > 2 * reach:
        first, last = words[:reach], []
        low, at, step = words[reach - 1].end(), high, _STEP
        while at > low and len(last) <= reach:  # one word more: the first may be cut
            at, step = max(low, at - step), 2 * step
            last = list(_TERM.finditer(text, at, high))
        words = first + last[len(last) - reach :]
    return [(*m.span(), m[0].lower()) for m in words]


def _near_terms(text: str, spans: list[tuple[str, int, int]], reach: int) -> set[tuple[str, str]]:
    """Pairs of an entity and a term close to it: ``reach`` words on either side that lie outside
    all entities, which are stepped over whole."""
    words, end = [], 0
    for a, b in [*sorted((a, b) for _, a, b in spans), (len(text), len(text))]:
        if a > end:
            words += _outer_words(text, end, a, reach)
        end = max(end, b)
    starts, ends = [a for a, _, _ in words], [b for _, b, _ in words]
    pairs = set()
    for kind, a, b in spans:
        name, before, after = _entity(kind, text[a:b]), bisect_right(ends, a), bisect_left(starts, b)
        near = words[max(0, before - reach) : before] + words[after : after + reach]
        pairs.update((name, term) for _, _, term in near)
    return pairs


_FOUND = (
    "kinds array<string>, starts array<int>, ends array<int>, names array<string>, "
    "entities array<string>, terms array<string>"
)


def _find(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for value in batch.column(batch.num_columns - 1):
            text = value.as_py()
            spans = base_spans(text)
            pairs = sorted(_near_terms(text, spans, reach)) if spans else []
            for column, part in zip(out, (
                [k for k, _, _ in spans], [a for _, a, _ in spans], [b for _, _, b in spans],
                sorted({_entity(k, text[a:b]) for k, a, b in spans}), [e for e, _ in pairs], [t for _, t in pairs],
            )):
                column.append(part)
        kinds = [pa.list_(t) for t in (pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 3)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *[pa.array(c, t) for c, t in zip(out, kinds)]],
            names=[*batch.schema.names[:-1], "kinds", "starts", "ends", "names", "entities", "terms"],
        )


def _look(batches: Iterator[pa.RecordBatch], table: bytes) -> Iterator[pa.RecordBatch]:
    """Words that the bit table lets through, with all their places in the text."""
    known: dict[str, bool] = {}
    place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def out(batch: pa.RecordBatch, found: list[tuple[int, str, list]]) -> pa.RecordBatch:
        kept = batch.select([0, 1]).take(pa.array([i for i, _, _ in found], pa.int64()))
        return pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array([t for _, t, _ in found], pa.string()), pa.array([p for _, _, p in found], place)],
            names=["doc_id", "_digest", "term", "places"],
        )

    for batch in batches:
        found: list[tuple[int, str, list]] = []
        size = 0
        for i, value in enumerate(batch.column(2)):
            text = value.as_py()
            # Lower-casing may change the length of a text, so places are those of the text itself.
            words = set(_TERM.findall(text))
            new = [w for w in words if w not in known]
            if new:
                known.update(zip(new, has_bits([w.lower().encode() for w in new], table).tolist()))
            hits = {w for w in words if known[w]}
            if len(known) >= _KNOWN_WORDS:
                known.clear()
            if hits:
                by_term: dict[str, list] = {}
                for m in _TERM.finditer(text):
                    if m[0] in hits:
                        by_term.setdefault(m[0].lower(), []).append({"start": m.start(), "end": m.end()})
                        size += 1
                found += [(i, term, places) for term, places in by_term.items()]
            if size >= _PLACES:
                yield out(batch, found)
                found, size = [], 0
        yield out(batch, found)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(content).alias("_digest"), content.alias("_text"))


def levels(entity: Column) -> Column:
    """An entity's value and its group. No value is named as a group is."""
    kind = F.substring_index(entity, ":", 1)
    group = (
        F.when(kind == "email", F.regexp_replace(entity, ":.*@", ":@"))
        .when(kind == "ip", F.regexp_replace(entity, r"[^.]*$", ""))
        .when(kind == "card", F.concat(F.substring(entity, 1, len("card:") + ISSUER), F.lit("*")))
        .otherwise(F.concat(F.left(entity, F.length(entity) - TAIL), F.lit("*")))
    )
    return F.array(entity, group)


def entity_counts(found: DataFrame) -> tuple[int, DataFrame]:
    """The number of distinct texts, and for each entity of any level the number of those it is in."""
    total = found.select("_digest").distinct().count()
    named = found.select("_digest", F.explode("names").alias("name"))
    named = named.select("_digest", F.explode(levels(F.col("name"))).alias("entity")).distinct()
    return total, named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))


def smoothed(n: Column) -> Column:
    """What a count of texts stands for. One text may as well be chance, so it counts half; each
    further text halves the doubt."""
    return n - F.pow(F.lit(2.0), -n)


def unknown(n_both: str, n_term: str) -> Column:
    """Bits of an entity that remain unknown where a term is seen."""
    return F.log2(F.col(n_term) / smoothed(F.col(n_both)))


def disclosing_terms(places: DataFrame, pairs: DataFrame, total: int, generalise: float, remove: float) -> DataFrame:
    """term and action of the terms that disclose an entity beyond a threshold.

    places: candidates and the texts they are in; pairs: entity, term, n_both and n_entity.
    """
    texts = places.select("term", "_digest").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    rated = pairs.join(texts, "term").withColumn("left", unknown("n_both", "n_term"))
    least = rated.where(gives(total)).groupBy("term").agg(F.min("left").alias("left"))
    action = F.when(F.col("left") <= remove, F.lit("remove")).otherwise("generalise")
    return least.where(F.col("left") <= generalise).select("term", action.alias("action"))


def gives(total: int) -> Column:
    """Whether a term gives enough of an entity's information: of n_both, n_term and n_entity."""
    return F.log2(F.lit(float(max(1, total))) / F.col("n_entity")) - unknown("n_both", "n_term") >= MIN_BITS


def find(
    docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH, generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, _digest (a hash of its text), base and added, both
    arrays of (kind, start, end), sorted, in code points with the end exclusive. Added spans are of
    kind generalise or remove and never overlap a base span.

    Null texts are empty and have no spans. Rows with one key and one text have equal results. An
    empty table gives no rows; further columns are ignored.
    """
    rows = spread(_rows(docs, key, text))
    kind = docs.schema[key].dataType.simpleString()
    found = written(
        rows.mapInArrow(lambda batches: _find(batches, reach), f"doc_id {kind}, _digest long, {_FOUND}"), "entities"
    )
    near = found.select("_digest", F.explode(F.arrays_zip("entities", "terms")).alias("p"))
    near = written(near.select("_digest", F.col("p.entities").alias("entity"), F.col("p.terms").alias("term")).distinct(), "near")
    total, entities = entity_counts(found)
    raised = near.select("_digest", F.explode(levels(F.col("entity"))).alias("entity"), "term").distinct()
    pairs = raised.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    # A term is in no fewer texts than it is close to any entity in: what can't reach the threshold
    # by that number is no candidate.
    at_least = near.select("term", "_digest").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    least = 0.999999 * 2.0**-generalise  # of the smoothed count in n_term
    enough = lambda n: smoothed(F.col("n_both")) >= least * F.col(n)
    rated = lookup_join(pairs.where(enough("n_both")), at_least, "term").where(enough("n_term"))
    rated = lookup_join(rated, entities, "entity").where(gives(total))
    pairs = written(rated.select("entity", "term", "n_both", "n_entity"), "pairs")
    candidates = pairs.select("term").distinct()
    table = bit_table(candidates.withColumnRenamed("term", "key"), bits_for(pairs.count()))
    place = "array<struct<start:int,end:int>>"
    places = rows.mapInArrow(
        lambda batches: _look(batches, table), f"doc_id {kind}, _digest long, term string, places {place}"
    )
    places = written(places.join(candidates, "term", "left_semi"), "places")
    chosen = disclosing_terms(places, pairs, total, generalise, remove)
    spans = places.join(chosen, "term").select(
        "doc_id", "_digest", F.explode(F.transform("places", lambda p: F.struct(
            F.col("action").alias("kind"), p["start"].alias("start"), p["end"].alias("end")
        ))).alias("span"),
    )
    # Rows with equal key and text share their spans: each span once.
    added = spans.groupBy("doc_id", "_digest").agg(F.array_sort(F.collect_set("span")).alias("_added"))
    added = added.select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_d"), "_added")
    none = F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int>>)")
    base = F.expr(
        "transform(arrays_zip(kinds, starts, ends), x -> struct(x.kinds AS kind, x.starts AS start, x.ends AS end))"
    )
    out = found.select("doc_id", "_digest", base.alias("base")).join(
        added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")), "left"
    )
    clear = F.filter(
        F.coalesce("_added", none),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return out.select("doc_id", "_digest", "base", clear.alias("added"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last two columns: text and spans. Leaves the text with its spans replaced."""
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            if spans:
                parts, end = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= end:  # the longest of overlapping ones stands for them
                        parts += [text[end : s["start"]], replacement(s["kind"], text[s["start"] : s["end"]])]
                    end = max(end, s["end"])
                text = "".join(parts) + text[end:]
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], pa.array(texts, pa.string())], names=[*batch.schema.names[:-2], "_text"]
        )


def replacement(kind: str, text: str) -> str:
    """The name of the kind; a generalised term becomes the kind of word it is; a removed one, nothing."""
    if kind == "remove":
        return ""
    if kind == "generalise":
        return "[NUMBER]" if text[0].isdigit() else "[NAME]" if text[0].isupper() else "[WORD]"
    return f"[{kind.upper()}]"


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with all spans of :func:`find` replaced in ``text``; other columns and null texts
    stay as they are."""
    spans = find(docs, key, text, **options).select(
        F.col("doc_id").alias("_id"), F.col("_digest").alias("_d"), F.concat("base", "added").alias("_spans")
    ).where(F.size("_spans") > 0).dropDuplicates(["_id", "_d"])
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text}  # own names can't clash
    content = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(text).alias("_text"), content.alias("_digest"))
    joined = rows.join(spans, F.col(names[key]).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")), "left")
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in names.items())
    done = joined.select(*names.values(), "_text", "_spans").mapInArrow(_redact, f"{fields}, _text string")
    return done.select(*[F.col("_text" if c == text else names[c]).alias(c) for c in docs.columns])
