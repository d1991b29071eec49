"""URL filters: host rules, then empirical-Bayes host reputation.

Every host has a beta-binomial posterior of its rate of bad pages. Its prior is
centred on its registered domain's posterior mean, that one's on its public
suffix's, and that one's on the rate of all pages. How strongly a level shrinks
to the one above is estimated from the data (method of moments over the level's
groups). A host is blocked if the posterior's lower bound exceeds ``tolerated``.
Where a rule fits a url, the rule decides.

DataFrame functions only. Outcomes are counted by host before anything is
joined by host; the level statistics are one row. A page is bad if its label
has quality 0 or toxic 1; repeated labels of a page count once (bad if any is).

Defined cases: a null url or one without ``://`` has an empty host and path and
is judged as the host ''; hosts without labelled pages have their domain's
rate; without labels all hosts have the rate 1/2 and are allowed; repeated or
null page ids are judged row by row; a bound that equals ``tolerated`` is
allowed; an empty table of pages gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.kr", "co.in", "co.nz", "com.cn", "com.mx", "com.tr")
TOLERATED = 0.5
Z = 1.645  # one-sided 95 %
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Public suffix and registered domain (the suffix and one label more)."""
    labels = F.split(host, r"\.")
    n = F.when(F.substring_index(host, ".", -2).isin(*two_labels), 2).otherwise(1) if two_labels else F.lit(1)
    return F.when(n == 2, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1)), F.when(F.size(labels) <= n, host).when(n == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matching_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for text, said in sorted(rules.items(), key=lambda x: (-len(x[0]), x[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _strength(groups: DataFrame, n: str, bad: str) -> Column:
    """Pseudo-count of the prior by moments: between-group variance beyond what binomial noise explains."""
    rate = F.sum(bad) / F.nullif(F.sum(n), F.lit(0))
    spread = F.sum(F.when(F.col(n) > 0, F.col(bad) * F.col(bad) / F.col(n))) - F.sum(bad) * F.sum(bad) / F.nullif(F.sum(n), F.lit(0))
    free = F.count_if(F.col(n) > 0) - 1
    weight = F.sum(n) - F.sum(F.col(n) * F.col(n)) / F.nullif(F.sum(n), F.lit(0)) - free
    excess = F.try_divide(F.try_divide(spread, rate * (1 - rate)) - free, weight)
    return F.greatest(F.lit(1.0), F.least(F.lit(10000.0), F.coalesce(F.when(excess > 0, 1 / excess - 1), F.lit(10000.0))))


def host_reputation(pages: DataFrame, labels: DataFrame, z: float = Z, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n_labelled, n_bad, mean, bound) of every host of ``pages`` (page_id, host)."""
    bad = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("long")).alias("bad"))
    hosts = pages.select("page_id", "host").join(bad, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    suffix, domain = suffix_and_domain(F.col("host"), two_labels)
    hosts = hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("domain_n"), F.sum("k").alias("domain_k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("domain_n").alias("suffix_n"), F.sum("domain_k").alias("suffix_k"))
    by_host = hosts.agg(_strength(hosts, "n", "k").alias("m"), F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    by_domain = domains.agg(_strength(domains, "domain_n", "domain_k").alias("m")).first().m
    by_suffix = suffixes.agg(_strength(suffixes, "suffix_n", "suffix_k").alias("m")).first().m
    overall = ((by_host.k or 0) + 1) / ((by_host.n or 0) + 2)
    suffixes = suffixes.select("suffix", ((F.col("suffix_k") + by_suffix * overall) / (F.col("suffix_n") + by_suffix)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("domain_k") + by_domain * F.col("suffix_mean")) / (F.col("domain_n") + by_domain)).alias("domain_mean"))
    a = F.col("k") + by_host.m * F.col("domain_mean")
    b = F.col("n") - F.col("k") + by_host.m * (1 - F.col("domain_mean"))
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(domains, "domain").select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), (a / (a + b)).alias("mean"), bound.alias("bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES, tolerated: float = TOLERATED, z: float = Z) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_bound) of every page."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    known = host_reputation(judged, labels, z).select("host", F.col("bound").alias("bad_bound"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    return judged.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("bad_bound") > tolerated, "block").otherwise("allow")).alias("verdict"), F.round("bad_bound", 6).alias("bad_bound"))


def judge_urls_sql(rules: dict[str, str] = RULES, tolerated: float = TOLERATED, z: float = Z, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> str:
    """The same in DuckDB SQL."""
    two = ", ".join(f"'{x}'" for x in two_labels)
    fits = "\n".join(f"when (host = '{t[: t.index('/')]}' or ends_with(host, '.{t[: t.index('/')]}')) and starts_with(path, '{t[t.index('/') :]}') then '%s'" for t in sorted(rules, key=lambda x: (-len(x), x)))
    chain = lambda values: "case " + fits % tuple(values) + " end"
    ordered = sorted(rules, key=lambda x: (-len(x), x))
    level = lambda n, k: f"""greatest(1.0, least(10000.0, coalesce(case when e > 0 then 1 / e - 1 end, 10000.0))) from (select ((sum(case when {n} > 0 then {k} * {k} / {n}::double end) - sum({k}) * sum({k}) / nullif(sum({n}), 0)::double) / nullif(r * (1 - r), 0) - f) / nullif(sum({n}) - sum({n} * {n}) / nullif(sum({n}), 0)::double - f, 0) as e"""
    strength = lambda of, n, k: f"(select {level(n, k)} from {of}, (select sum({k}) / nullif(sum({n}), 0)::double as r, count(*) filter ({n} > 0) - 1 as f from {of}) group by r, f)"
    return f"""
with u as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
l as (select doc_id as page_id, max(case when coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 then 1 else 0 end) as bad from labels
      where doc_id is not null and (quality is not null or toxic is not null) group by 1),
h0 as (select host, count(bad) as n, coalesce(sum(bad), 0)::bigint as k, string_split(host, '.') as parts from p left join l using (page_id) group by host),
h1 as (select *, case when array_to_string(parts[-2:], '.') in ({two}) then 2 else 1 end as w from h0),
h as (select host, n, k, array_to_string(parts[-w:], '.') as suffix, array_to_string(parts[-(w + 1):], '.') as domain from h1),
d as (select suffix, domain, sum(n)::bigint as dn, sum(k)::bigint as dk from h group by 1, 2),
s as (select suffix, sum(dn)::bigint as sn, sum(dk)::bigint as sk from d group by 1),
c as (select (sum(k) + 1) / (sum(n) + 2)::double as overall, {strength("h", "n", "k")}) as mh, {strength("d", "dn", "dk")}) as md, {strength("s", "sn", "sk")}) as ms from h),
s2 as (select suffix, (sk + ms * overall) / (sn + ms) as sm from s, c),
d2 as (select domain, (dk + md * sm) / (dn + md) as dm from d join s2 using (suffix), c),
ab as (select host, k + mh * dm as a, n - k + mh * (1 - dm) as b from h join d2 using (domain), c),
r as (select host, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from ab)
select page_id, host, path, {chain(ordered)} as rule,
       coalesce({chain([rules[t] for t in ordered])}, case when bound > {tolerated} then 'block' else 'allow' end) as verdict,
       round(bound, 6) as bad_bound
from p left join r using (host)
"""
