"""Registered queries that SQL can express, with their twins: decontamination and licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, licenses
from corpusloom.plans.tables import table


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_tokens", "matched", "places")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_TOKENS = r"[x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> '']"
_KEYS = " UNION ALL ".join(
    f"SELECT id, {m} AS mask, i - 1 AS at, concat_ws(' ', {', '.join(f't[i + {o}]' for o in mask)}) AS key "
    f"FROM (SELECT id, t, unnest(range(1, len(t) - {decontaminate.SPAN - 2})) AS i FROM {{source}} "
    f"WHERE len(t) >= {decontaminate.SPAN})"
    for m, mask in enumerate(decontaminate.MASKS)
)

OP4_SQL = f"""
WITH doc AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL),
item AS (SELECT item_id AS id, {_TOKENS} AS t FROM benchmark WHERE text IS NOT NULL),
doc_key AS ({_KEYS.format(source="doc")}),
item_key AS ({_KEYS.format(source="item")}),
hit AS (
  SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.at - i.at AS shift
  FROM doc_key d JOIN item_key i ON d.mask = i.mask AND d.key = i.key),
laid AS (
  SELECT doc_id, item_id, len(i.t) AS n, least({decontaminate.WINDOW}, len(i.t)) AS w,
    [CASE WHEN d.t[p + shift + 1] = i.t[p + 1] THEN 1 ELSE 0 END
     FOR p IN range(greatest(0, -shift), least(len(i.t), len(d.t) - shift))] AS same
  FROM hit h JOIN doc d ON d.id = h.doc_id JOIN item i ON i.id = h.item_id),
good AS (
  SELECT doc_id, item_id, n, list_sum(same) AS matched FROM laid
  WHERE len(same) >= w AND list_bool_or(
    [list_sum(same[s : s + w - 1]) >= ceil(w * {decontaminate.AGREE}) FOR s IN range(1, len(same) - w + 2)]))
SELECT doc_id, item_id, max(n)::INT AS item_tokens, max(matched)::INT AS matched, count(*) AS places
FROM good GROUP BY doc_id, item_id
"""

_KNOWN, _RULES = licenses.numbered(licenses.SENTENCES, licenses.RULES)
_MAP = ", ".join(f"'{s}': {n}" for s, n in _KNOWN.items())
_NORMAL = (
    f"regexp_replace(replace(trim(regexp_replace(lower(s), '{licenses.NOT_PLAIN}', ' ', 'g')), 'licence', 'license'), "
    f"'{licenses.NOTICE}', 'copyright notice')"
)
_STEPS = ",\n".join(
    f"r{i + 1} AS (SELECT doc_id, n_sentences, n_known, first_known, replace(line, ',{seq}', ',x,') AS line, "
    f"CASE WHEN contains(line, ',{seq}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') "
    f"ELSE found END AS found FROM r{i})"
    for i, (name, seq) in enumerate(_RULES)
)

OP9_SQL = rf"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '{licenses.MARK_END}', '\1' || chr(1), 'g'),
    '{licenses.LINE_END}', chr(1) || '\1', 'g'), chr(1)) AS parts
  FROM documents),
known AS (SELECT map {{{_MAP}}} AS m),
ids AS (
  SELECT doc_id, [coalesce(m[{_NORMAL}], 0) FOR s IN parts] AS ids FROM cut, known),
r0 AS (
  SELECT doc_id, len(ids)::INT AS n_sentences, len([x FOR x IN ids IF x > 0])::INT AS n_known,
    (list_position([x > 0 FOR x IN ids], true) - 1)::BIGINT AS first_known,
    regexp_replace(regexp_replace(',' || array_to_string(ids, ',') || ',', '(,0){{{licenses.GAP + 1},}},', ',x,', 'g'),
      '(,0)+,', ',', 'g') AS line, []::VARCHAR[] AS found
  FROM ids WHERE len([x FOR x IN ids IF x > 0]) > 0),
{_STEPS}
SELECT doc_id, n_sentences, n_known, first_known, array_to_string(found, ',') AS licences FROM r{len(_RULES)}
"""
