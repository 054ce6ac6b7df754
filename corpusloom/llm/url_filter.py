"""URL filtering: listed rules first, then the reputation of the host.

Reputation is an empirical-Bayes estimate of the share of bad pages. Labelled outcomes are counted
per host and shrunk along the chain all pages, suffix, registered domain, host: at each level the
groups below a parent share a beta prior around the parent's estimate, whose strength comes from
the spread of the groups (moments of the beta-binomial). A host is blocked when the lower bound of
its posterior passes a threshold, so a few bad labels do not condemn a host. The bound is the beta
distribution's own: it lies above the threshold where the distribution function there is below the
tail allowed, and that function is summed as a series in one row's expression.

Only built-in column functions are used. Counting is partial before its shuffle. A host with very
many pages is a skewed join against one row per host, which adaptive execution splits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Two-part suffixes: one of these labels before a two-letter country.
TWO_PART = "(?:ac|co|com|edu|gov|net|org)"
SUFFIX = rf"(?:{TWO_PART}\.[a-z][a-z]|[^.]*)$"
ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*)$"
ADDRESSES = "#ip"  # the suffix of numeric hosts; no host holds this sign
BEFORE_HOST, BEHIND_HOST = r"(?s)^.*@", r"\.?(?::[0-9]*)?\z"
MIN_RHO, MAX_RHO = 0.0001, 0.5  # correlation of outcomes within a group: prior of 9999 to 1 pages
TAIL = 0.05  # posterior probability left below the bound
MAX_BAD = 0.5

Rule = tuple[str, str, str]  # verdict, host, path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. Both are empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domain_parts(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Registered domain and public suffix: one of the listed ``suffixes`` (any length, such as
    ``github.io``), else the last two labels where the first of them is a usual second level under a
    country, else the last label. User names, ports and a final dot do not count. A numeric host is
    its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, BEFORE_HOST, ""), BEHIND_HOST, "")
    listed = "".join(name.replace(".", r"\.") + "|" for name in sorted(suffixes, key=len, reverse=True))
    end = f"(?:{listed}{SUFFIX[3:]}"
    numeric = bare.rlike(ADDRESS)
    return (
        F.when(numeric, bare).otherwise(F.regexp_extract(bare, rf"(?:[^.]*\.)?{end}", 0)),
        F.when(numeric, ADDRESSES).otherwise(F.regexp_extract(bare, rf"(?:^|\.)({end[:-1]})$", 1)),
    )


def _ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of positive numbers: Stirling's series, eight steps up."""
    w = z + 8
    series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7)
    below = reduce(lambda product, k: product * (z + k), range(1, 8), z)
    return (w - 0.5) * F.ln(w) - w + 0.5 * math.log(2 * math.pi) + series - F.ln(below)


def beta_below(a: Column, b: Column, x: float) -> Column:
    """Probability that a beta variable of ``a`` and ``b`` (both positive) is at most ``x`` (between 0
    and 1). The series is taken from the side where its terms fall from the first on; the number of
    terms follows from a and b, and leaves less than 1e-12."""
    least = min(x, 1 - x)
    terms = F.ceil(8 * F.sqrt((a + b) / least) + 40 / least).cast("int")

    def lower(p: Column, q: Column, y: float) -> Column:
        start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
        step = lambda s, j: F.struct(
            (s["term"] * (p + q + j) / (p + 1 + j) * y).alias("term"), (s["total"] + s["term"]).alias("total")
        )
        total = F.aggregate(F.sequence(F.lit(0), terms), start, step, lambda s: s["total"])
        ln_beta = _ln_gamma(p) + _ln_gamma(q) - _ln_gamma(p + q)
        return F.exp(p * math.log(y) + q * math.log(1 - y) - ln_beta) / p * total

    return F.when((a + b + 2) * x <= a + 1, lower(a, b, x)).otherwise(1 - lower(b, a, 1 - x))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host`` + ``path``) and its verdict, null where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's. The list is a
    parameter and becomes one expression: no join.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        under = (host == rule_host) | host.endswith("." + rule_host)
        fits = under & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _shrunk(groups: DataFrame) -> DataFrame:
    """Groups (n, bad, and prior: the parent's estimate) with strength and rate. The strength is
    one number for the level, from totals over its groups."""
    n, bad, prior = F.col("n"), F.col("bad"), F.col("prior")
    even = prior * (1 - prior)
    spread = groups.agg(
        F.sum((bad - n * prior) ** 2 - n * even).alias("over"), F.sum(n * (n - 1) * even).alias("pairs")
    ).first()
    rho = spread["over"] / spread["pairs"] if spread["pairs"] else MIN_RHO
    strength = 1 / min(max(rho, MIN_RHO), MAX_RHO) - 1
    return groups.withColumns({
        "strength": F.lit(strength), "rate": (bad + F.lit(strength) * prior) / (n + F.lit(strength)),
    })


def host_reputation(outcomes: DataFrame, max_bad: float = MAX_BAD, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row per host of ``outcomes`` (host, bad: boolean, null for pages without a label):
    n and bad (labelled and bad pages), bad_rate (posterior mean) and doubt (posterior probability
    that the rate is at most ``max_bad``).

    Hosts without labels get what their domain says. No labels at all: a rate of one half with a
    weak prior.
    """
    domain, suffix = domain_parts(F.col("host"), suffixes)
    hosts = written(outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad")
    ).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    seen = hosts.agg(*sums).first()
    root = ((seen["bad"] or 0) + 1) / ((seen["n"] or 0) + 2)
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(root)))
    prior = suffixes.select("suffix", F.col("rate").alias("prior"))
    domains = _shrunk(hosts.groupBy("domain", "suffix").agg(*sums).join(prior, "suffix"))
    prior = domains.select("domain", F.col("rate").alias("prior"))
    rated = _shrunk(hosts.join(prior, "domain"))
    bad = F.col("bad") + F.col("strength") * F.col("prior")
    good = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))
    return rated.select(
        "host", "n", "bad", F.col("rate").alias("bad_rate"), beta_below(bad, good, max_bad).alias("doubt")
    )


def judge(
    pages: DataFrame,
    rules: list[Rule],
    key: str = "page_id",
    url: str = "url",
    bad: str = "bad",
    tail: float = TAIL,
    max_bad: float = MAX_BAD,
    suffixes: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``pages`` (key, url, and the label ``bad``: boolean or null): key, host,
    path, rule, verdict (allow or block), and the host's counts and bounds.

    The verdict is the longest fitting rule's, else block where the lower bound of the host's bad
    rate (the quantile at ``tail`` of its posterior) passes ``max_bad``. Urls that can't be read share the empty host. Repeated rows are judged
    each, null keys are kept, an empty table gives no rows, further columns are ignored.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), F.col(bad).alias("bad"))
    known = host_reputation(rows.select("host", "bad"), max_bad, suffixes)
    known = known.select("host", "n", F.col("bad").alias("n_bad"), "bad_rate", "doubt")
    rule, listed = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("doubt") < tail, F.lit("block")).otherwise("allow")
    return rows.drop("bad").join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(listed, own).alias("verdict"),
        F.col("n").alias("host_labelled"), F.col("n_bad").alias("host_bad"), "bad_rate", "doubt",
    )
