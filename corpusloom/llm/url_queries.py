"""The registered query of the URL filter and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import url_filter
from corpusloom.plans.tables import table

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DOC_IN_URL = r"://[^/?#]*/[^/?#]*/([0-9]{1,18})"


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the outcome of the document they show: bad if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL OR toxic IS NOT NULL")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    labels = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    number = F.regexp_extract("url", DOC_IN_URL, 1)
    doc = F.when(number != "", number).cast("bigint")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", doc.alias("doc_id"))
    return pages.join(labels, "doc_id", "left")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(labelled_pages(spark, sf_dir), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "host_labelled", "host_bad")


_SHRUNK = """
{name}_spread AS (
  SELECT sum((n_bad - n * prior) ** 2 - n * prior * (1 - prior)) AS o,
         sum(n * (n - 1) * prior * (1 - prior)) AS p FROM {name}),
{name}_rated AS (
  SELECT g.*, 1 / least(greatest(CASE WHEN p > 0 THEN o / p ELSE 0.0001 END, 0.0001), 0.5) - 1 AS strength
  FROM {name} g, {name}_spread),
{name}_rate AS (
  SELECT *, (n_bad + strength * prior) / (n + strength) AS rate FROM {name}_rated)"""

OP7_SQL = rf"""
WITH label AS (
  SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
page AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    try_cast(regexp_extract(url, '{DOC_IN_URL}', 1) AS bigint) AS doc_id
  FROM (SELECT page_id, url, coalesce(rest, '') AS rest FROM cut)),
host AS (
  SELECT host, count(bad) AS n, count(*) FILTER (bad) AS n_bad,
    CASE WHEN regexp_matches(bare, '{url_filter.ADDRESS}') THEN bare
      ELSE regexp_extract(bare, '(?:[^.]*\.)?{url_filter.SUFFIX}', 0) END AS domain,
    CASE WHEN regexp_matches(bare, '{url_filter.ADDRESS}') THEN '{url_filter.ADDRESSES}'
      ELSE regexp_extract(bare, '(?:^|\.)({url_filter.SUFFIX[:-1]})$', 1) END AS suffix
  FROM (SELECT *, regexp_replace(regexp_replace(host, '{url_filter.BEFORE_HOST}', ''), '{url_filter.BEHIND_HOST}', '') AS bare
    FROM page) LEFT JOIN label USING (doc_id) GROUP BY host, bare),
root AS (SELECT (coalesce(sum(n_bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS prior FROM host),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(n_bad) AS n_bad, any_value(prior) AS prior FROM host, root GROUP BY suffix),
{_SHRUNK.format(name="suffixes")},
domains AS (
  SELECT domain, sum(h.n) AS n, sum(h.n_bad) AS n_bad, any_value(s.rate) AS prior
  FROM host h JOIN suffixes_rate s USING (suffix) GROUP BY domain),
{_SHRUNK.format(name="domains")},
hosts AS (
  SELECT h.host, h.n, h.n_bad, d.rate AS prior FROM host h JOIN domains_rate d USING (domain)),
{_SHRUNK.format(name="hosts")},
sides AS (
  SELECT *, n_bad + strength * prior AS a, n - n_bad + strength * (1 - prior) AS b,
    ({url_filter.MAX_BAD} * (a + b + 2) <= a + 1) AS low, CASE WHEN low THEN a ELSE b END AS p, a + b AS s,
    CASE WHEN low THEN {url_filter.MAX_BAD} ELSE 1 - {url_filter.MAX_BAD} END AS y
  FROM hosts_rate),
bounded AS (
  SELECT *, exp(p * ln(y) + (s - p) * ln(1 - y) + lgamma(s) - lgamma(p) - lgamma(s - p)) / p * list_sum(
      [exp(lgamma(s + k) - lgamma(s) - lgamma(p + 1 + k) + lgamma(p + 1) + k * ln(y))
       for k in range(CAST(100 + 12 * sqrt(s) AS bigint))]) AS below,
    CASE WHEN low THEN below ELSE 1 - below END AS doubt
  FROM sides),
rule AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')) r(kind, rule_host, rule_path)),
fits AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(kind, length(rule_host || rule_path)) AS kind
  FROM page, rule
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.kind, CASE WHEN doubt < {url_filter.TAIL} THEN 'block' ELSE 'allow' END) AS verdict,
  n AS host_labelled, n_bad AS host_bad
FROM page p JOIN bounded USING (host) LEFT JOIN fits f USING (page_id)
"""
