"""SQL twin of the recursive splitter, for the engine that checks the results.

It works the other way round from the operator: whole levels at a time over all documents,
then a recursive query that walks the windows of every run.
"""

from __future__ import annotations

from collections.abc import Sequence


def quoted(s: str) -> str:
    """SQL string with control characters written as chr(n)."""
    parts, plain = [], ""
    for ch in s:
        if ord(ch) < 32:
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
            parts.append(f"chr({ord(ch)})")
            plain = ""
        else:
            plain += ch
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


SPACE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def split_ctes(source: str, name: str, size: int, overlap: int, separators: Sequence[str]) -> str:
    """CTEs that end in ``{name}(id, start, content)`` for ``source(id, txt)``."""
    ctes = [f"{name}_t0 AS (SELECT id, 0::BIGINT AS lo, txt FROM {source} WHERE txt <> '')"]
    runs = []
    for level, sep in enumerate(separators):
        todo, deeper = f"{name}_t{level}", f"{name}_t{level + 1}"
        if not sep:
            runs.append(
                f"SELECT id, {level} AS lvl, lo AS run_at, range(lo, lo + length(txt) + 1) AS cuts FROM {todo}"
            )
            continue
        s = quoted(sep)
        parts = f"{name}_p{level}"
        ctes.append(f"""{parts} AS (
  SELECT id, lo, part, len, (lo + coalesce(sum(len) OVER before, 0))::BIGINT AS pos,
         count(*) FILTER (len >= {size}) OVER before AS run_no
  FROM (SELECT id, lo, n, part, length(part) AS len
        FROM (SELECT id, lo, n, CASE WHEN n = 1 THEN raw ELSE {s} || raw END AS part
              FROM (SELECT id, lo, unnest(raws) AS raw, generate_subscripts(raws, 1) AS n
                    FROM (SELECT id, lo, string_split(txt, {s}) AS raws
                          FROM {todo} WHERE contains(txt, {s}))))
        WHERE part <> '')
  WINDOW before AS (PARTITION BY id, lo ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
        runs.append(f"""SELECT id, {level} AS lvl, min(pos) AS run_at,
       list_prepend(min(pos), list(pos + len ORDER BY pos)) AS cuts
FROM {parts} WHERE len < {size} GROUP BY id, lo, coalesce(run_no, 0)""")
        ctes.append(f"""{deeper} AS (
  SELECT id, pos AS lo, part AS txt FROM {parts} WHERE len >= {size}
  UNION ALL SELECT id, lo, txt FROM {todo} WHERE NOT contains(txt, {s}))""")
    ctes.append(f"{name}_r AS (" + "\nUNION ALL ".join(runs) + ")")
    ctes.append(f"""{name}_w AS (
  SELECT id, lvl, run_at, cuts, 1 AS i,
         len(list_filter(cuts, lambda c: c <= cuts[1] + {size})) AS j FROM {name}_r
  UNION ALL
  SELECT id, lvl, run_at, cuts, k AS i, len(list_filter(cuts, lambda c: c <= cuts[k] + {size})) AS j
  FROM (SELECT id, lvl, run_at, cuts,
               1 + len(list_filter(cuts, lambda c: c < greatest(cuts[j] - {overlap}, cuts[j + 1] - {size}))) AS k
        FROM {name}_w WHERE j < len(cuts)))""")
    ctes.append(f"""{name} AS (
  SELECT id, start, content FROM (
    SELECT w.id, cuts[i] AS start,
           trim(substring(s.txt, (cuts[i] + 1)::BIGINT, (cuts[j] - cuts[i])::BIGINT), {SPACE}) AS content
    FROM {name}_w w JOIN {source} s ON w.id = s.id)
  WHERE content <> '')""")
    return ",\n".join(ctes)


WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"


def chunk_select(pieces: str) -> str:
    """Chunk rows from ``pieces(doc_id, source, seg, start, kind, piece)``."""
    return f"""SELECT doc_id, source, chunk_position, total_chunks, chunk_type,
  substring(md5(piece || chunk_position::VARCHAR), 1, 16) AS chunk_id,
  length(piece)::BIGINT AS chunk_size, {WORDS.format('piece')}::BIGINT AS word_count,
  trim(piece, {SPACE}) AS content
FROM (SELECT doc_id, source, kind AS chunk_type, piece,
        row_number() OVER (PARTITION BY doc_id ORDER BY seg, start) - 1 AS chunk_position,
        count(*) OVER (PARTITION BY doc_id) AS total_chunks
      FROM {pieces})"""
