"""URL filter: rules first, then empirical-Bayes host reputation (DataFrame functions only).

Pages that a rule decides are the labelled outcomes (block = 1).  Outcomes are counted per host and shrunk through
beta-binomial priors: a host towards its registered domain, a domain towards its suffix, a suffix towards Beta(1, 1).
The strength of the prior under a parent is the method-of-moments precision of its children's rates.  A host without
a fitting rule is blocked when the lower posterior bound of its block rate passes ``threshold``.  The bound of a
Beta(a, b) is that of a normal with the mean and variance of its log-odds, psi(a) - psi(b) and psi'(a) + psi'(b): unlike
one on the rate itself it stays within 0 and 1, and follows the skew that one or two outcomes leave (by up to 0.08 too low there).

A host's suffix and domain leave out user and port; an address of numbers is its own domain and suffix.  ``suffixes``, a table
of public-suffix rules (``co.uk``, ``*.ck``, ``!www.ck``), decides where a suffix ends: the exception, or else the longest rule that
fits.  Without the table, a suffix is the last label, or the last two where a country's two letters follow one of
``SECOND_LEVEL``.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged as host ``''``.
Repeated rows are judged one by one and all kept; an empty table gives an empty result; extra columns pass through
``judge_urls`` unless they carry one of the names it adds, which it replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import BROADCAST_ROWS, ascii_lower, others, packed, table, unpacked

#: (verdict, host with path prefix)
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Labels that countries sort names under.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")
Z, THRESHOLD, WEAKEST, STRONGEST = 1.2816, 0.5, 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def bare_host(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _last(labels: Column, n: Column | int) -> Column:
    """The last labels, dotted; all of them where there are fewer."""
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.size(labels)), ".")


def with_domain(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (one row a host) with domain and suffix."""
    bare = hosts.withColumn("bare", bare_host(F.col("host"))).withColumn("labels", F.split("bare", "[.]"))
    numbers = F.rlike("bare", F.lit(r"^[0-9.]+$|^\["))
    country = F.rlike(F.element_at("labels", -1), F.lit("^[a-z]{2}$")) & F.try_element_at("labels", F.lit(-2)).isin(*SECOND_LEVEL)
    own = F.when(F.coalesce(country, F.lit(False)), 2).otherwise(1)
    if suffixes is not None:
        # Every tail of a host meets the rules: as it is, as what follows a wildcard, or as an exception.
        rules = F.broadcast(suffixes.select(F.lower("suffix").alias("rule")).distinct()) if suffixes.count() <= BROADCAST_ROWS else suffixes.select(F.lower("suffix").alias("rule")).distinct()
        tail = lambda n: F.array(*(F.struct(text.alias("rule"), size.alias("n"), F.lit(first).alias("first")) for text, size, first in ((_last(F.col("labels"), n), n, 0), (F.concat(F.lit("*."), _last(F.col("labels"), n - 1)), n, 0), (F.concat(F.lit("!"), _last(F.col("labels"), n)), n - 1, 1))))
        tails = bare.select("host", F.inline(F.flatten(F.transform(F.sequence(F.lit(1), F.size("labels")), tail))))
        ends = tails.join(rules, "rule").groupBy(F.col("host").alias("h")).agg(F.max_by("n", F.struct("first", "n")).alias("ends"))
        bare, own = bare.join(ends, F.col("host") == F.col("h"), "left"), F.coalesce("ends", F.lit(1))
    bare = bare.withColumn("own", own)
    cut_at = lambda n: F.when(numbers, F.col("bare")).otherwise(_last(F.col("labels"), n))
    return bare.select(*hosts.columns, cut_at(F.col("own") + 1).alias("domain"), cut_at(F.col("own")).alias("suffix"))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it, and the start of the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _strength(rate_gap: Column, parent_rate: Column, n: Column) -> Column:
    """Beta precision of the children under one parent by the method of moments (an aggregate)."""
    total, children = F.sum(n), F.count_if(n > 0)
    spread = F.sum(n * rate_gap * rate_gap)
    noise = F.max(parent_rate * (1 - parent_rate))
    room = total - F.sum(n * n) / F.nullif(total, F.lit(0.0))
    between = F.when(room > 0, (spread - noise * (children - 1)) / room)
    fitted = F.when(between > 0, noise / between - 1).otherwise(F.lit(STRONGEST))
    return F.coalesce(F.least(F.greatest(fitted, F.lit(WEAKEST)), F.lit(STRONGEST)), F.lit(STRONGEST))


def _with_strength(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    rate = F.coalesce(F.col("k") / F.nullif("n", F.lit(0)), F.lit(0.0))
    means = parents.select(key, (F.coalesce(F.col("k") / F.nullif("n", F.lit(0)), F.lit(0.0))).alias("parent_rate"))
    fitted = (
        children.select(key, F.col("n").cast("double").alias("n"), rate.alias("rate"))
        .join(means, key)
        .groupBy(key)
        .agg(_strength(F.col("rate") - F.col("parent_rate"), F.col("parent_rate"), F.col("n")).alias("strength"))
    )
    return parents.join(fitted, key)


def _digamma(x: str) -> str:
    """psi(x) as SQL: six steps of its recurrence, then four terms of the asymptotic series."""
    y = f"({x} + 6)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * {y} * {y} * {y} * {y}) - ({' + '.join(f'1 / ({x} + {i})' for i in range(6))}))"


def _trigamma(x: str) -> str:
    """psi'(x) as SQL, likewise."""
    y = f"({x} + 6)"
    return f"(1 / {y} + 1 / (2 * {y} * {y}) + 1 / (6 * {y} * {y} * {y}) - 1 / (30 * {y} * {y} * {y} * {y} * {y}) + {' + '.join(f'1 / (({x} + {i}) * ({x} + {i}))' for i in range(6))})"


def _low(z: float) -> str:
    """The lower bound of Beta(a, b) as SQL."""
    return f"1 / (1 + exp(-({_digamma('a')} - {_digamma('b')} - {z} * sqrt({_trigamma('a')} + {_trigamma('b')}))))"


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, outcome 1/0/null) rows to one row per host with its posterior.

    Counts are combined before any shuffle, so a host with a third of all rows costs one row per task."""
    n, k = F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("k")
    hosts = with_domain(outcomes.groupBy("host").agg(n, k), suffixes)
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.min("suffix").alias("suffix"))
    suffix = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    suffix_mean = _with_strength(suffix, domains, "suffix").select("suffix", F.col("strength").alias("s"), ((F.col("k") + 1) / (F.col("n") + 2)).alias("m"))
    domain_mean = (
        _with_strength(domains, hosts, "domain")
        .join(suffix_mean, "suffix")
        .select("domain", F.col("strength").alias("s"), ((F.col("s") * F.col("m") + F.col("k")) / (F.col("s") + F.col("n"))).alias("m"))
    )
    posterior = hosts.join(domain_mean, "domain").select(
        "host", "n", "k", (F.col("s") * F.col("m") + F.col("k")).alias("a"), (F.col("s") * (1 - F.col("m")) + F.col("n") - F.col("k")).alias("b")
    )
    return posterior.select("host", "n", "k", (F.col("a") / (F.col("a") + F.col("b"))).alias("block_rate"), F.expr(_low(z)).alias("block_rate_low"))


ADDED = ("host", "path", "rule", "verdict", "block_rate_low")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, z: float = Z, threshold: float = THRESHOLD, suffixes: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_rate_low."""
    host, path = url_parts(F.col("url"))
    parsed = packed(pages, host=F.coalesce(host, F.lit("")), path=F.coalesce(path, F.lit("")))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("row", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    outcome = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    reputation = host_reputation(parsed.select("host", outcome.alias("outcome")), z, suffixes)
    # Dealt out anew, so that the join's exchange is one that adaptive execution may split for a hot host.
    reputation = reputation.select("host", "block_rate_low").repartition(reputation.sparkSession.sparkContext.defaultParallelism)
    own = F.when(F.col("block_rate_low") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    met = parsed.join(reputation, "host", "left").withColumn("verdict", F.coalesce("ruled", own))
    return unpacked(met, others(pages, ADDED), **{c: F.col(c) for c in ADDED})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql_rule(column: int) -> str:
    cases = []
    for what, text in sorted(RULES, key=lambda r: -len(r[1])):
        rule_host, slash, rest = text.partition("/")
        said = (text, what)[column]
        cases.append(f"WHEN (host = '{rule_host}' OR ends_with(host, '.{rule_host}')) AND starts_with(path, '{slash}{rest}') THEN '{said}'")
    return f"CASE {' '.join(cases)} END"


_SECOND = ", ".join(f"'{s}'" for s in SECOND_LEVEL)


def _sql_strength(children: str, parents: str, key: str) -> str:
    return f"""
  SELECT {key}, coalesce(least(greatest(CASE WHEN between_var > 0 THEN noise / between_var - 1 ELSE {STRONGEST} END, {WEAKEST}), {STRONGEST}), {STRONGEST}) AS strength FROM (
    SELECT {key}, noise, CASE WHEN room > 0 THEN (spread - noise * (children - 1)) / room END AS between_var FROM (
      SELECT c.{key}, max(p.rate * (1 - p.rate)) AS noise, sum(c.n * (c.rate - p.rate) * (c.rate - p.rate)) AS spread, count(*) FILTER (c.n > 0) AS children,
        sum(c.n) - sum(c.n * c.n) / nullif(sum(c.n), 0)::DOUBLE AS room
      FROM (SELECT {key}, n::DOUBLE AS n, coalesce(k / nullif(n, 0)::DOUBLE, 0) AS rate FROM {children}) c
      JOIN (SELECT {key}, coalesce(k / nullif(n, 0)::DOUBLE, 0) AS rate FROM {parents}) p USING ({key}) GROUP BY 1))"""


ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT page_id, host, path, {_sql_rule(0)} AS rule, {_sql_rule(1)} AS ruled FROM parts),
hosts AS (SELECT host, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM ruled GROUP BY host),
labelled AS (SELECT *, string_split(bare, '.') AS l, regexp_matches(bare, '^[0-9.]+$|^\\[') AS numbers FROM hosts),
ends AS (SELECT *, CASE WHEN len(l) > 1 AND regexp_full_match(l[-1], '[a-z]{{2}}') AND l[-2] IN ({_SECOND}) THEN 2 ELSE 1 END AS own FROM labelled),
h AS (SELECT host, n, k, CASE WHEN numbers THEN bare ELSE array_to_string(l[greatest(len(l) - own, 1):], '.') END AS domain, CASE WHEN numbers THEN bare ELSE array_to_string(l[greatest(len(l) - own + 1, 1):], '.') END AS suffix FROM ends),
d AS (SELECT domain, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, min(suffix) AS suffix FROM h GROUP BY 1),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM d GROUP BY 1),
ss AS ({_sql_strength('d', 's', 'suffix')}),
ds AS ({_sql_strength('h', 'd', 'domain')}),
sm AS (SELECT suffix, strength AS s, (k + 1) / (n + 2)::DOUBLE AS m FROM s JOIN ss USING (suffix)),
dm AS (SELECT domain, ds.strength AS s, (sm.s * sm.m + d.k) / (sm.s + d.n) AS m FROM d JOIN ds USING (domain) JOIN sm USING (suffix)),
post AS (SELECT host, s * m + k AS a, s * (1 - m) + n - k AS b FROM h JOIN dm USING (domain)),
verdicts AS (SELECT host, CASE WHEN {_low(Z)} > {THRESHOLD} THEN 'block' ELSE 'allow' END AS own FROM post)
SELECT page_id, r.host, path, rule, coalesce(ruled, own) AS verdict FROM ruled r JOIN verdicts v ON r.host = v.host
"""
