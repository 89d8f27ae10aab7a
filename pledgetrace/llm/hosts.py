"""URL filter: rules first, else the reputation of the host.

Reputation is the share of good pages, shrunk level by level: all pages, suffix (last label of the
host), registered domain (last two), host. The posterior mean of a level is the prior mean of the
next one down, with a strength that the beta-binomial moments of that level give (empirical
Bayes). A page without a rule is allowed if the lower posterior bound of its host is high enough.
A host without labelled pages has its domain's prior as its posterior, and so on up.

Defined cases. A null url, or one without ``://``, has an empty host and path and is judged by the
reputation of the empty host. Pages with a null id, or whose label is null, count as unlabelled;
of several labels of a page the least counts. Repeated rows are repeated outcomes and each get a
verdict. Without any label the mean is 1/2. Empty tables give no rows. Other columns of the
input are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: (host, path, verdict); fixed values of the query
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: standard deviations below the mean, the least bound that is allowed, and strengths' limits
DEVIATIONS, LEAST, WEAKEST, STRONGEST = 1.645, 0.5, 1.0, 1000.0
#: weight of the overall mean against 1/2
OVERALL = 2.0


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, the first of equals; null without one."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        if rule is None:
            rule, verdict = F.when(fits, h + p), F.when(fits, v)
        else:
            rule, verdict = rule.when(fits, h + p), verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _strength(level: DataFrame) -> float:
    """Strength s of a beta prior around ``prior`` from the spread of ``good`` of ``n``: with
    rho = 1 / (s + 1) the expectation of sum n (good / n - prior)^2 is sum prior (1 - prior)
    (1 + (n - 1) rho)."""
    q = F.col("prior") * (1 - F.col("prior"))
    r = level.filter("n > 0").agg(
        F.sum(F.pow(F.col("good") - F.col("n") * F.col("prior"), 2) / F.col("n")).alias("seen"),
        F.sum(q).alias("least"), F.sum(q * (F.col("n") - 1)).alias("slope")).first()
    if not r["slope"]:
        return STRONGEST
    rho = (r["seen"] - r["least"]) / r["slope"]
    return STRONGEST if rho <= 0 else min(max(1 / rho - 1, WEAKEST), STRONGEST)


def _down(level: DataFrame, by: str, above: DataFrame | float) -> tuple[DataFrame, float]:
    """Posterior (a, b) of each ``by`` of a level, its prior mean from the level above."""
    if isinstance(above, float):
        held = level.withColumn("prior", F.lit(above))
    else:
        held = level.join(above, by)
    held = stage(held, "level")
    s = _strength(held)
    return held.withColumn("a", s * F.col("prior") + F.col("good")).withColumn(
        "b", s * (1 - F.col("prior")) + F.col("n") - F.col("good")), s


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bound) from (host, n labelled pages, good ones of these)."""
    labels = F.split("host", r"\.")
    hosts = stage(outcomes.withColumn("suffix", F.element_at(labels, -1)).withColumn(
        "domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")), "hosts")
    count = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain").agg(F.min("suffix").alias("suffix"), *count)
    total = hosts.agg(*count).first()
    mean = (OVERALL * 0.5 + float(total["good"] or 0)) / (OVERALL + float(total["n"] or 0))
    mean_of = F.col("a") / (F.col("a") + F.col("b"))
    suffixes, _ = _down(domains.groupBy("suffix").agg(*count), "suffix", mean)
    domains, _ = _down(domains, "suffix", suffixes.select("suffix", mean_of.alias("prior")))
    hosts, _ = _down(hosts, "domain", domains.select("domain", mean_of.alias("prior")))
    a, b = F.col("a"), F.col("b")
    bound = a / (a + b) - DEVIATIONS * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", bound.alias("bound"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; ``outcomes`` has (page_id, good 0/1)."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    counts = seen.select("page_id", "host").join(marks, "page_id", "left").groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    judged = stage(host_reputation(counts), "reputation")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return seen.join(judged, "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bound") >= LEAST, "allow").otherwise("block")).alias("verdict"))


def _level_sql(name: str, of: str) -> str:
    return f"""
{name}_p as ({of}),
{name}_s as (select case when coalesce(sum(prior * (1 - prior) * (n - 1)), 0) = 0 then 1000.0
  when sum(pow(good - n * prior, 2) / n) - sum(prior * (1 - prior)) <= 0 then 1000.0
  else least(greatest(sum(prior * (1 - prior) * (n - 1)) / (sum(pow(good - n * prior, 2) / n) - sum(prior * (1 - prior))) - 1, 1.0), 1000.0) end as s
 from {name}_p where n > 0),
{name} as (select p.*, s * prior + good as a, s * (1 - prior) + n - good as b from {name}_p as p, {name}_s)"""


ORACLE = r"""
with seen as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
marks as (select doc_id as page_id, min(quality) as good from labels where quality is not null group by 1),
h0 as (select host, count(good)::double as n, coalesce(sum(good), 0)::double as good from seen left join marks using (page_id) group by host),
h as (select *, string_split(host, '.')[-1] as suffix, array_to_string(string_split(host, '.')[-2:], '.') as domain from h0),
d as (select domain, min(suffix) as suffix, sum(n) as n, sum(good) as good from h group by 1),
x as (select suffix, sum(n) as n, sum(good) as good from d group by 1),""" + ",".join((
    _level_sql("suffixes", "select x.*, (select (1 + sum(good)) / (2 + sum(n)) from h) as prior from x"),
    _level_sql("domains", "select d.*, u.a / (u.a + u.b) as prior from d join suffixes as u using (suffix)"),
    _level_sql("hosts", "select h.*, u.a / (u.a + u.b) as prior from h join domains as u using (domain)"))) + """,
r as (select host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from hosts),
j as (select page_id, host, path, bound, case
  when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
  when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
  when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
  when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from seen join r using (host))
select page_id, host, path, rule, case rule when 'example.net/en/' then 'allow' when 'example.com/de/' then 'block'
  when 'org/fr/' then 'allow' when 'net/' then 'block' else case when bound >= 0.5 then 'allow' else 'block' end end as verdict
from j
"""
