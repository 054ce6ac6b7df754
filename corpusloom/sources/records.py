"""Records of large files, cut in parallel: elements of a JSON array, lines of a quoted CSV.

Where a record ends can't be told from its place alone: a brace or a line end may stand in a string.
What is needed is little, though. Spark's text source deals the file out in splits, at every brace
or line end. Each split reports the parity of its quotes, and how much deeper it goes in either
case; sums of these over the splits before give each split the state that it starts in. Knowing
that, every task cuts its own records, and only the ends of splits are put together afterwards. No
task holds more than a split, or a single record that is larger.

The file is read twice, by Spark's own reader, so from wherever Spark can read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import small_side
from corpusloom.session import written

TAIL = 1 << 20  # longest text behind the last record that is looked at
_STATE = ("block", "odd", "outside", "inside", "bytes", "file_bytes")
_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _json_step(piece: str) -> tuple[int, int, int]:
    """Of a piece that ends at a closing brace: quotes (odd or even), and the change of depth if it
    starts outside of a string, and if inside."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    parts = piece.split('"')
    odd = (len(parts) - 1) & 1
    depth = [0, 0]
    for state in (0, 1):
        plain = "".join(parts[state::2])
        depth[state] = plain.count("{") + plain.count("[") - plain.count("]") - (state == odd)
    return odd, depth[0], depth[1]


def _csv_step(piece: str) -> tuple[int, int, int]:
    return piece.count('"') & 1, 0, 0


def _summary(batches: Iterator[pa.RecordBatch], step: Callable) -> Iterator[pa.RecordBatch]:
    """A row per split: parity of its quotes, change of depth from outside and from inside, bytes
    with those of the marks, and the bytes of its file."""
    rows: dict[tuple, list[int]] = {}
    for batch in batches:
        for piece, path, block, length, whole in zip(*(c.to_pylist() for c in batch.columns)):
            odd, outside, inside = step(piece)
            state = rows.setdefault((path, block), [0, 0, 0, 0, whole])
            change = (outside, inside)
            state[1] += change[state[0]]
            state[2] += change[1 - state[0]]
            state[0] ^= odd
            state[3] += length + 1
    schema = pa.schema([("path", pa.string()), *[(n, pa.int64()) for n in _STATE]])
    columns = list(zip(*[(*k, *v) for k, v in rows.items()])) if rows else [[] for _ in schema]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch], step: Callable, ends: int, mark: str) -> Iterator[pa.RecordBatch]:
    """Whole records (part 1), and what a split has of a record that began before it (part 0) or
    ends behind it (part 2). A record ends at a piece's end outside of strings at depth ``ends``;
    the last piece of a file that no mark follows ends none."""
    schema = pa.schema([
        ("path", pa.string()), ("block", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("ended", pa.bool_()), ("value", pa.string()),
    ])
    out: list[tuple] = []
    size = 0
    key, held, whole, at, odd, depth, unmarked = None, [], False, 0, 0, 0, False

    def made(rows):
        columns = list(zip(*rows)) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    def leave():
        """The end of a split."""
        if held:
            out.append((*key, 2 if whole else 0, at, False, mark.join(held)))
        elif unmarked and out and out[-1][:2] == key:
            *last, part, place, _, value = out.pop()
            out.append((*last, 2 if part == 1 else 0, place, False, value))

    for batch in batches:
        for piece, path, block, start, deep, open_ in zip(*(c.to_pylist() for c in batch.columns)):
            if (path, block) != key:
                leave()
                key, held, whole, at, odd, depth, unmarked = (path, block), [], block == 0, 0, start, deep, open_
            flip, outside, inside = step(piece)
            depth += inside if odd else outside
            odd ^= flip
            held.append(piece)
            size += len(piece)
            if not odd and depth == ends:
                out.append((*key, 1 if whole else 0, at, True, mark.join(held)))
                held, whole, at = [], True, at + 1
        if size > 1 << 24:
            yield made(out[:-1])  # the last may have to be taken back
            out, size = out[-1:], 0
    leave()
    yield made(out)


def _records(spark: SparkSession, paths: list[str], mark: str, step: Callable, ends: int, marked: bool) -> DataFrame:
    """path, block, at (their order in a file), ended, and value: the pieces of a record joined by
    ``mark``. The one record of a file that does not end is not gathered if it is long: null. With
    ``marked`` a record ends with a mark only, not with the end of its file."""
    text = spark.read.option("lineSep", mark).option("recursiveFileLookup", True).text(paths)
    pieces = text.select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.octet_length("value").cast("long").alias("_bytes"), F.col("_metadata.file_size").alias("_size"),
    )
    split = "path string, " + ", ".join(f"{n} long" for n in _STATE)
    summary = written(pieces.mapInArrow(partial(_summary, step=step), split), "splits")
    file = Window.partitionBy("path")
    before = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = summary.withColumn("_odd", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    starts = starts.withColumn("_change", F.when(F.col("_odd") == 1, F.col("inside")).otherwise(F.col("outside")))
    last = (F.col("block") == F.max("block").over(file)) & (F.sum("bytes").over(file) > F.col("file_bytes"))
    starts = starts.select(
        "path", "block", "_odd", F.coalesce(F.sum("_change").over(before), F.lit(0)).alias("_depth"),
        (last & F.lit(marked)).alias("_unmarked"),
    )
    starts, _ = small_side(starts, "starts")  # a row per split
    known = pieces.join(starts, ["path", "block"]).select("value", "path", "block", "_odd", "_depth", "_unmarked")
    row = "path string, block long, part long, at long, ended boolean, value string"
    cut = written(known.mapInArrow(partial(_cut, step=step, ends=ends, mark=mark), row), "records")

    # The parts of records that reach over splits: which belong together is settled without their texts.
    earlier = file.orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.col("ended").cast("int")).over(earlier), F.lit(0))
    parts = cut.where("part <> 1")  # two for each split at most
    sorted_ = parts.select("path", "block", "part", "ended", F.length("value").alias("_length"), ended.alias("_of"))
    whole = Window.partitionBy("path", "_of")
    sorted_ = sorted_.select(
        "path", "block", "part", "_of", (F.max("ended").over(whole) | (F.sum("_length").over(whole) <= TAIL)).alias("_kept")
    )
    parts = parts.join(sorted_, ["path", "block", "part"])
    place = F.struct("block", "part")
    joined = parts.groupBy("path", "_of").agg(
        F.min("block").alias("block"), F.min_by("at", place).alias("at"), F.max("ended").alias("ended"),
        F.max("_kept").alias("_kept"),
        F.sort_array(F.collect_list(F.struct("block", "part", F.when(F.col("_kept"), F.col("value")).alias("v")))).alias("_parts"),
    )
    value = F.when(F.col("_kept"), F.array_join(F.transform("_parts", lambda p: p["v"]), mark))
    joined = joined.select("path", "block", "at", "ended", value.alias("value"))
    return cut.where("part = 1").select("path", "block", "at", "ended", "value").unionByName(joined)


def json_elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, block, at and value: JSON arrays of one or a few elements each, together the elements of
    the arrays in the given files. Where a file is no array of objects, or breaks off, it has a null
    value, or one that is no JSON; what was whole before that is kept."""
    rows = _records(spark, paths, "}", _json_step, 1, marked=True)
    text = F.when(F.col("ended"), F.concat("value", F.lit("}"))).otherwise(F.col("value"))
    first = (F.col("block") == 0) & (F.col("at") == 0)
    rows = rows.select("path", "block", "at", "ended", first.alias("_first"), F.regexp_replace(text, "^[\\s\ufeff]+|\\s+$", "").alias("_t"))
    sign = F.substring("_t", 1, 1)
    closed = F.col("ended") | F.endswith("_t", F.lit("]"))
    inner = F.expr("CASE WHEN ended THEN substring(_t, 2) ELSE substring(_t, 2, length(_t) - 2) END")
    body = (
        F.when(~closed, F.lit(None)).when(~F.col("ended") & ~F.col("_first") & (F.col("_t") == "]"), F.lit(""))
        .when(sign == F.when(F.col("_first"), "[").otherwise(","), inner)
    )
    rows = rows.select("path", "block", "at", "ended", F.trim(body).alias("_body"))
    none = ~F.col("ended") & F.coalesce(F.col("_body") == "", F.lit(False))  # nothing behind the last object
    return rows.where(~none).select("path", "block", "at", F.concat(F.lit("["), "_body", F.lit("]")).alias("value"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """path, block, at and value: each record of the CSV files below a path as one text, with the
    line ends that its quoted fields hold. A blank line is no record; a record whose quotes are not
    closed at the end of its file has a null value."""
    rows = _records(spark, [path], "\n", _csv_step, 0, marked=False)
    value = F.when(F.col("ended"), F.regexp_replace("value", "\\r$", ""))
    return rows.select("path", "block", "at", value.alias("value")).where("value IS NULL OR trim(value) <> ''")
