"""A stored collection that takes upserts in place.

Rows lie in a fixed number of hash buckets. An upsert reads and rewrites the buckets that hold a
written id (or document) and no others: it writes them to a folder of its own, and then one small
manifest that names, for every bucket, the write its rows are in. The manifest appears by a rename
that fails if its number is taken (on file systems whose rename is atomic), so a reader sees all of
a write or nothing of it, a job that dies leaves the old table as it was, and of two writers at once
one fails and can try again.

    <path>/rows/write=<n>-<name>/bucket=<b>/...   rows of bucket b as of a write
    <path>/stats/write=<n>-<name>/...             partial statistics of the buckets of a write
    <path>/manifests/<n>.json                     bucket -> write, schema, layout

Old versions stay readable until :func:`vacuum` deletes what the kept manifests do not name.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusloom.operators import store
from corpusloom.operators.joins import small_side

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made the version that was about to be made."""


@dataclass(frozen=True)
class Manifest:
    """What a version consists of. ``folders`` has the write that each filled bucket is in."""

    version: int
    buckets: int
    id_col: str
    document_col: str | None
    schema: str
    folders: dict[int, str] = field(default_factory=dict)
    stats_by: list[str] = field(default_factory=list)
    tag: str | None = None

    @property
    def key(self) -> str:
        """The column that decides on the bucket: a document's rows lie together."""
        return self.document_col or self.id_col


# --- manifests ------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions that can be read, in order."""
    fs, place = _fs(spark, f"{path}/manifests")
    if not fs.exists(place):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """That of a version, or of the newest one."""
    if version is None:
        known = versions(spark, path)
        if not known:
            raise FileNotFoundError(f"no collection at {path}")
        version = known[-1]
    fs, place = _fs(spark, f"{path}/manifests/{version}.json")
    stream = fs.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    data = json.loads(text)
    return Manifest(**data | {"folders": {int(b): v for b, v in data["folders"].items()}})


def _publish(spark: SparkSession, path: str, made: Manifest) -> None:
    fs, draft = _fs(spark, f"{path}/manifests/.{made.version}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(asdict(made)).encode()))
    out.close()
    _, final = _fs(spark, f"{path}/manifests/{made.version}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {made.version} of {path} has been written by another job")


# --- rows -----------------------------------------------------------------------------------------


def bucket_of(key: str | Column, buckets: int) -> Column:
    """The bucket of a key, from its digest as text; a null key counts as an empty one."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def _read(spark: SparkSession, path: str, of: Manifest, only: list[int] | None = None) -> DataFrame:
    """The rows of a version with their ``bucket``, of some buckets or all."""
    fields = StructType.fromJson(json.loads(of.schema)).fields
    schema = StructType([*fields, StructField("bucket", IntegerType()), StructField("write", StringType())])
    wanted = {b: w for b, w in of.folders.items() if only is None or b in only}
    if not wanted:
        return spark.createDataFrame([], schema).drop("write")
    paths = [f"{path}/rows/write={w}/bucket={b}" for b, w in sorted(wanted.items())]
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*paths).drop("write")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the collection, as of the newest version or an older one."""
    return _read(spark, path, manifest(spark, path, version)).drop("bucket")


def read_keys(spark: SparkSession, path: str, keys: list, version: int | None = None) -> DataFrame:
    """The rows of some ids (or documents, where the layout goes by document): only the files of
    their buckets are read."""
    of = manifest(spark, path, version)
    held = spark.createDataFrame([(None if k is None else str(k),) for k in keys], "k string")
    only = [r[0] for r in held.select(bucket_of("k", of.buckets)).distinct().collect()]  # as many as keys given
    return _read(spark, path, of, only).where(F.col(of.key).isin(list(keys))).drop("bucket")


def beside(keys: DataFrame, path: str, key_col: str) -> DataFrame:
    """The rows of the collection in the buckets of the given keys: those of the keys, and others."""
    spark = keys.sparkSession
    of = manifest(spark, path)
    only = [r[0] for r in keys.select(bucket_of(key_col, of.buckets)).distinct().collect()]  # buckets at most
    return _read(spark, path, of, only).drop("bucket")


def _next(old: Manifest) -> str:
    """A name for the write of the next version."""
    return f"{old.version + 1}-{uuid.uuid4().hex[:12]}"


def _deal(rows: DataFrame, path: str, of: Manifest, name: str) -> list[int]:
    """Write rows to the folder of a write, bucket by bucket; the buckets that got any."""
    dealt = rows.withColumn("bucket", bucket_of(of.key, of.buckets)).hint("rebalance", "bucket")
    dealt.write.partitionBy("bucket").parquet(f"{path}/rows/write={name}")
    fs, place = _fs(rows.sparkSession, f"{path}/rows/write={name}")
    found = [f.getPath().getName() for f in fs.listStatus(place)]
    return sorted(int(n[7:]) for n in found if n.startswith("bucket="))


def _discard(spark: SparkSession, path: str, name: str) -> None:
    fs, place = _fs(spark, f"{path}/rows/write={name}")
    fs.delete(place, True)


def _finish(
    spark: SparkSession, path: str, old: Manifest, name: str, filled: list[int], touched: list[int], tag: str | None
) -> Manifest:
    """Publish the version whose touched buckets are those that a write has filled."""
    folders = {b: w for b, w in old.folders.items() if b not in touched} | {b: name for b in filled}
    made = replace(old, version=old.version + 1, folders=folders, tag=tag)
    if filled and old.stats_by:
        mine = _read(spark, path, made, filled)
        partial_stats(mine, old.id_col, old.stats_by).write.parquet(f"{path}/stats/write={name}")
    _publish(spark, path, made)
    return made


def _write(spark: SparkSession, path: str, rows: DataFrame, old: Manifest, touched: list[int], tag: str | None) -> Manifest:
    """Write the new rows of the touched buckets and publish the version that has them."""
    name = _next(old)
    return _finish(spark, path, old, name, _deal(rows, path, old, name), touched, tag)


def _apply(
    new: DataFrame, path: str, old: Manifest, seq: Column, replace_document: bool = False,
    version_col: str | None = None, tag: str | None = None,
) -> Manifest | None:
    """Write ``new`` over the version ``old``; none if there is nothing to write.

    The rows are dealt to their buckets as they come. Where these hold nothing yet and no id comes
    twice, that is the write already. Else it is merged with what the buckets hold, and goes. What
    has to be left out or comes twice is found on keys alone, so rows move for it only if there is any.
    """
    spark, name = new.sparkSession, _next(old)
    fields = StructType.fromJson(json.loads(old.schema)).fields
    given = {c.lower() for c in new.columns}
    columns = [(F.col(f.name) if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    chosen = new.select(*columns, seq.alias("_seq"))
    touched = _deal(chosen, path, old, name)
    if not touched:
        _discard(spark, path, name)
        return None
    staged = replace(old, schema=chosen.schema.json(), folders={b: name for b in touched})
    batch = _read(spark, path, staged).drop("bucket")
    unique = batch.groupBy(old.id_col).count().where("count > 1").isEmpty()
    if unique and not set(touched) & set(old.folders):
        return _finish(spark, path, old, name, touched, touched, tag)
    held = _read(spark, path, old, touched).drop("bucket")
    if version_col:
        stored = held.groupBy(F.col(old.key).alias("_stored")).agg(F.max(version_col).alias("_newest"))
        offered = batch.select(F.col(old.key).alias("_key"), F.col(version_col).alias("_at")).distinct()
        newer = F.col("_key").eqNullSafe(F.col("_stored")) & (F.col("_at") < F.col("_newest"))
        outdated, count = small_side(offered.join(stored, newer, "left_semi"), "outdated")
        if count:
            same = batch[old.key].eqNullSafe(F.col("_key")) & (batch[version_col] == F.col("_at"))
            batch = batch.join(outdated, same, "left_anti")
    document = old.document_col if replace_document else None
    rows = store.upsert(held, batch.drop("_seq") if unique else batch, old.id_col, None if unique else "_seq", document)
    made = _write(spark, path, rows, old, touched, tag)
    _discard(spark, path, name)
    return made


def create(
    rows: DataFrame, path: str, id_col: str = "id", document_col: str | None = None, buckets: int = BUCKETS,
    stats_by: tuple[str, ...] = (), seq_col: str | None = None,
) -> Manifest:
    """Write a new collection, unique by id (the last by ``seq_col`` stays; without one any of the
    rows that share an id). ``document_col`` lays it out by document instead of by id. Statistics
    are kept for the columns ``stats_by``."""
    spark = rows.sparkSession
    clash = {c.lower() for c in rows.columns} & {"bucket", "write"}
    if clash:
        raise ValueError(f"names of the layout: {sorted(clash)}")
    if versions(spark, path):
        raise Conflict(f"there is a collection at {path}")
    schema = rows.drop(seq_col).schema if seq_col else rows.schema
    first = Manifest(0, buckets, id_col, document_col, schema.json(), stats_by=list(stats_by))
    made = _apply(rows, path, first, F.col(seq_col) if seq_col else F.lit(0))
    return made or _finish(spark, path, first, _next(first), [], [], None)


def upsert(
    new: DataFrame, path: str, seq_col: str = "seq", replace_document: bool = False,
    version_col: str | None = None, tag: str | None = None,
) -> Manifest:
    """Replace and add rows by id, the last write of an id within ``new`` wins. Only the buckets of
    the written keys are read and written.

    With ``replace_document`` all that a written document had before goes first. ``version_col``
    (of both tables) says how new a document's rows are: a document that is stored in a newer
    state is left as it is. A write with the ``tag`` of the newest version was made already and
    changes nothing, so a repeated job does no harm. Columns that the collection lacks are
    dropped, those that ``new`` lacks are null. Nothing to write makes no version.
    """
    old = manifest(new.sparkSession, path)
    if tag is not None and old.tag == tag:
        return old
    if replace_document and not old.document_col:
        raise ValueError("the collection is not laid out by document")
    return _apply(new, path, old, F.col(seq_col), replace_document, version_col, tag) or old


def layout(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Each filled bucket and the version that wrote its rows."""
    of = manifest(spark, path, version)
    rows = [(b, int(w.split("-")[0])) for b, w in of.folders.items()]  # a row per bucket
    return spark.createDataFrame(rows, "bucket int, version int")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete what the ``keep`` newest versions do not need, and what failed writers left; returns
    the versions that went. For times without a writer, and with no reader at an older version."""
    known = versions(spark, path)
    gone, kept = known[:-keep], known[-keep:]
    for n in gone:  # first, so that no reader finds a version whose rows are gone
        fs, place = _fs(spark, f"{path}/manifests/{n}.json")
        fs.delete(place, False)
    needed = {(w, b) for n in kept for b, w in manifest(spark, path, n).folders.items()}
    writes = {w for w, _ in needed}
    for kind in ("rows", "stats"):
        fs, place = _fs(spark, f"{path}/{kind}")
        for folder in list(fs.listStatus(place)) if fs.exists(place) else []:
            write = folder.getPath().getName().removeprefix("write=")
            if write not in writes:
                fs.delete(folder.getPath(), True)
            elif kind == "rows":
                for part in list(fs.listStatus(folder.getPath())):
                    bucket = part.getPath().getName().removeprefix("bucket=")
                    if bucket.isdigit() and (write, int(bucket)) not in needed:
                        fs.delete(part.getPath(), True)
    return gone


# --- statistics that merge ------------------------------------------------------------------------


def partial_stats(rows: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """Per bucket and value of each column ``by``: rows, and a sketch of the ids."""
    kinds = F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("string").alias("value")) for c in by])
    cut = rows.select("bucket", F.col(id_col).cast("string").alias("_id"), F.inline(kinds))
    return cut.groupBy("bucket", "of", "value").agg(
        F.count("*").alias("rows"), F.hll_sketch_agg("_id").alias("ids")
    )


def stored_stats(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows (exact) and estimated different ids per column and value, merged from what the writes
    left beside their rows: the collection itself is not read."""
    of = manifest(spark, path, version)
    if not of.folders or not of.stats_by:
        return spark.createDataFrame([], "of string, value string, rows bigint, ids bigint")
    live = spark.createDataFrame(list(of.folders.items()), "bucket int, write string")
    paths = [f"{path}/stats/write={w}" for w in sorted(set(of.folders.values()))]
    schema = "bucket int, of string, value string, rows bigint, ids binary, write string"
    parts = spark.read.schema(schema).option("basePath", f"{path}/stats").parquet(*paths)
    parts = parts.join(F.broadcast(live), ["bucket", "write"])  # a row per bucket
    merged = parts.groupBy("of", "value").agg(F.sum("rows").alias("rows"), F.hll_union_agg("ids").alias("_ids"))
    return merged.select("of", "value", "rows", F.hll_sketch_estimate("_ids").alias("ids"))
