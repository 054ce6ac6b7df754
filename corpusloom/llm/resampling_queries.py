"""The registered query of importance resampling and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import importance
from corpusloom.plans.tables import table


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# The checksum by its definition, byte by byte, for each distinct word.
_TABLE = (
    "(SELECT list(list_reduce([c] || [0::BIGINT FOR k IN range(8)], lambda x, y: "
    "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY c) FROM range(256) t(c))"
)
_BUCKETS = importance.BUCKETS

OP11_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM documents),
doc_word AS (SELECT n, word, count(*) AS c FROM (SELECT n, unnest(words) AS word FROM doc) GROUP BY ALL),
target_word AS (
  SELECT word, count(*) AS c FROM (SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS word FROM benchmark) GROUP BY ALL),
tab AS (SELECT {_TABLE} AS t),
bucket AS (
  SELECT word, xor(list_reduce([4294967295::BIGINT] || [('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT FOR i IN range(len(h) // 2)],
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % {_BUCKETS} AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM doc_word UNION SELECT word FROM target_word)), tab),
s AS (SELECT bucket, sum(c) AS c FROM doc_word JOIN bucket USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS c FROM target_word JOIN bucket USING (word) GROUP BY bucket),
gain AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.c, 0) + 1)::DOUBLE * ((SELECT sum(c) FROM s) + {_BUCKETS})::DOUBLE)
    / ((s.c + 1)::DOUBLE * (coalesce((SELECT sum(c) FROM t), 0) + {_BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT n, sum(c * gain)::BIGINT AS weight FROM doc_word JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY n),
scored AS (
  SELECT n, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM doc LEFT JOIN weight USING (n)),
placed AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS rank, count(*) OVER () AS total
  FROM scored WHERE n_features >= {importance.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {importance.PERCENT} * total // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (n)
"""
