"""Documents to chunks. One row in, many rows out, no shuffle: every operator here works on the
partitions it is given (see ``session.spread`` for scans with too few of them)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.splitting import pieces
from corpusloom.functions.text import chunk_id, strip, word_count

_PIECE = "chunk_position bigint, total_chunks bigint, chunk_type string, _piece string, error string"
_FLUSH = 2048  # chunks per Arrow batch


def chunk_columns(piece: Column, position: Column) -> dict[str, Column]:
    """Columns of a chunk from its unstripped text and its running number."""
    return {
        "chunk_id": chunk_id(piece, position),
        "chunk_size": F.length(piece).cast("bigint"),
        "word_count": word_count(piece),
        "content": strip(piece),
    }


def chunk_documents(
    docs: DataFrame,
    size: int = C.CHUNK_SIZE,
    overlap: int = C.CHUNK_OVERLAP,
    text_col: str = "content",
    type_col: str | None = "doc_type",
    keep_errors: bool = False,
) -> DataFrame:
    """Chunks of every document, with all other document columns copied to each chunk.

    API references are cut at their sections, documents with code fences around these, all
    others by paragraph, line, sentence, word, character. Empty documents give no rows. A
    document that fails gives no chunks; with ``keep_errors`` it gives one row with the error.
    """
    if overlap > size:
        raise ValueError("overlap must not exceed size")
    routed = type_col if type_col in docs.columns else None
    carried = [c for c in docs.columns if c not in (text_col, "sections")]
    source = docs.where(F.col(text_col) != "").select(
        *carried,
        (F.col(routed) if routed else F.lit(None).cast("string")).alias("_kind"),
        F.col(text_col).alias("_text"),
    )
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*carried).schema)
    names = [*carried, "chunk_position", "total_chunks", "chunk_type", "_piece", "error"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(batch.num_columns - 2).to_pylist()
            texts = batch.column(batch.num_columns - 1)
            rows, out = [], ([], [], [], [], [])

            def flush() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                left = [batch.column(i).take(at) for i in range(len(carried))]
                kinds_out = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                right = [pa.array(v, type=t) for v, t in zip(out, kinds_out)]
                return pa.RecordBatch.from_arrays(left + right, names=names)

            for row, kind in enumerate(kinds):
                try:
                    found = list(pieces(texts[row].as_py(), kind, size, overlap))
                    made = [(i, len(found), t, p, None) for i, (t, p) in enumerate(found)]
                except Exception as e:  # a bad document must not fail the corpus
                    made = [(None, None, None, None, f"{type(e).__name__}: {e}")]
                for values in made:
                    rows.append(row)
                    for column, value in zip(out, values):
                        column.append(value)
                if len(rows) >= _FLUSH:
                    yield flush()
                    rows, out = [], ([], [], [], [], [])
            if rows:
                yield flush()

    schema = f"{head}, {_PIECE}" if head else _PIECE
    chunks = source.mapInArrow(task, schema)
    if not keep_errors:
        chunks = chunks.where(F.col("error").isNull())
    built = chunk_columns(F.col("_piece"), F.col("chunk_position"))
    chunks = chunks.withColumns(built).drop("_piece")
    return chunks if keep_errors else chunks.drop("error")


def register_sql(spark: SparkSession, name: str = "chunk_text") -> None:
    """Table function for SQL: ``SELECT d.id, c.* FROM docs d, LATERAL chunk_text(d.content)``,
    optionally with document type, size and overlap as further arguments."""

    class ChunkText:
        def eval(self, text: str, kind: str = None, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP):
            for i, (what, piece) in enumerate(pieces(text, kind, size, overlap) if text else ()):
                yield i, what, piece.strip()

    made = F.udtf(ChunkText, returnType="chunk_position bigint, chunk_type string, content string", useArrow=True)
    spark.udtf.register(name, made)


def fixed_windows(
    docs: DataFrame,
    size: int = C.CHUNK_SIZE,
    overlap: int = C.CHUNK_OVERLAP,
    text_col: str = "content",
) -> DataFrame:
    """Windows of a fixed size and overlap, by built-in functions only."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    carried = [c for c in docs.columns if c != text_col]
    stride = size - overlap
    text = F.col(text_col)
    windows = F.greatest(F.lit(0), F.length(text) - F.lit(overlap + 1)) / F.lit(stride)
    windows = F.floor(windows).cast("int") + 1
    if overlap <= stride:
        # One pass: cut into strides, then put the head of the next stride behind each.
        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
        out = docs.where(text != "").select(
            *carried, windows.alias("total_chunks"), blocks.alias("_blocks")
        )
        parts = F.transform(
            F.slice("_blocks", 1, F.col("total_chunks")),
            lambda b, i: F.concat(
                b, F.substring(F.coalesce(F.get("_blocks", i + 1), F.lit("")), 1, overlap)
            ),
        )
    else:
        starts = F.sequence(F.lit(0), (windows - 1) * stride, F.lit(stride))
        parts = F.transform(starts, lambda at: F.substring(text, at + 1, F.lit(size)))
        out = docs.where(text != "").select(*carried, windows.alias("total_chunks"), text_col)
    out = out.select(
        *carried,
        F.col("total_chunks").cast("bigint").alias("total_chunks"),
        F.posexplode(parts).alias("chunk_position", "_piece"),
    ).withColumn("chunk_position", F.col("chunk_position").cast("bigint"))
    return out.withColumns(chunk_columns(F.col("_piece"), F.col("chunk_position"))).drop("_piece")


def cap_chunks(chunks: DataFrame, limit: int = C.MAX_CHUNKS_PER_DOCUMENT) -> DataFrame:
    """The declared cap on chunks per document, for those who want it; nothing applies it."""
    return chunks.where(F.col("chunk_position") < limit)


def _segments(text: Column) -> Column:
    """Fences and what stands between them, alternating: a mark opens a fence and the next one closes
    it, so every character is in one segment. Between two fences there is a segment, if an empty one."""
    mark = F.lit(C.FENCE)

    def segments(parts: Column) -> Column:
        count = F.size(parts)  # odd if every mark has its partner; a last one without is text
        return F.transform(
            F.slice(parts, 1, count - 1 + count % 2),
            lambda p, i: F.when(i % 2 == 1, F.concat(mark, p, mark))
            .when(i + 2 == count, F.concat(p, mark, F.get(parts, count - 1))).otherwise(p),
        )

    # As the element of an array the parts have a name, and a text is split once.
    return F.get(F.transform(F.array(F.split(text, C.FENCE, -1)), segments), F.lit(0))


def fence_segments(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """Code fences and the text around them, as rows in document order, in the JVM."""
    carried = [c for c in docs.columns if c != text_col]
    out = docs.select(*carried, F.posexplode(_segments(F.col(text_col))).alias("_at", "segment"))
    kind = F.when(F.startswith("segment", F.lit(C.FENCE)), "code").otherwise("text")
    return out.where(F.col("segment") != "").select(
        *carried, F.col("_at").cast("bigint").alias("segment_no"), kind.alias("kind"), "segment"
    )


def header_sections(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """Sections of a markdown document with the path of headers above each of them.

    Three nested splits, each at one header level: the header of an outer level is already on
    the row when the inner one is split, so no window and no shuffle is needed. Header-like
    lines inside code fences are not headers.
    """
    carried = [c for c in docs.columns if c != text_col]
    # Within fences a header sign gets a shield that is taken off at the end. What looks like a
    # shielded sign in the text itself gets one more.
    hold = "\x02"
    own = F.regexp_replace(F.col(text_col), f"(?md)^({hold}+#)", f"{hold}$1")
    shielded = F.transform(
        _segments(own),
        lambda s: F.when(
            F.startswith(s, F.lit(C.FENCE)), F.regexp_replace(s, "(?md)^#", f"{hold}#")
        ).otherwise(s),
    )
    out = docs.select(*carried, F.array_join(shielded, "").alias("_body"))
    keys: list[str] = []
    for level in (1, 2, 3):
        opener = "#" * level + " "
        # An opening header gives the first piece number 1; a preamble has number 0.
        base = F.startswith("_body", F.lit(opener)).cast("int")
        out = out.select(
            *carried, *keys, base.alias("_base"),
            F.posexplode(F.split("_body", f"(?md)^(?={opener})")).alias("_at", "_piece"),
        )
        headed = F.startswith("_piece", F.lit(opener))
        title = F.when(headed, strip(F.regexp_extract("_piece", f"(?d)\\A{opener}([^\\n]*)", 1)))
        rest = F.when(headed, F.regexp_replace("_piece", f"(?d)\\A{opener}[^\\n]*\\n?", ""))
        out = out.select(
            *carried, *keys,
            (F.col("_at") + F.col("_base")).cast("bigint").alias(f"no_{level}"),
            title.alias(f"header_{level}"),
            rest.otherwise(F.col("_piece")).alias("_body"),
        )
        keys += [f"no_{level}", f"header_{level}"]
    body = strip(F.regexp_replace(F.col("_body"), f"(?md)^{hold}({hold}*#)", "$1"))
    return out.select(*carried, *keys, body.alias("section")).where(F.col("section") != "")
