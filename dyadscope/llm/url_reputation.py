"""URL filters: longest fitting rule, else empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain and public suffix. Each
level is beta-binomial around the means of the level above: the method of moments over its groups gives
its overdispersion and so the strength of the prior, whose mean is the mean above. So a suffix is
shrunk to the whole, a domain to its suffix, a host to its domain; a host without labels has its
domain's reputation. A page is allowed if the lower bound of its host's posterior (mean less `z`
standard deviations) reaches `least`.

Only DataFrame operations. Pages are counted by host with map-side sums before anything is shuffled;
domains and suffixes are counted from hosts. Verdicts are joined back by host, where Spark splits a
host with a third of all pages.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to
`?`, `#` or the end. A rule fits its host and all subdomains if the path starts with the rule's path;
the longest host and path wins, of equal ones the first in text order.

Defined cases: a null url or one without `://` has an empty host and path, which form a group of their
own; null outcomes do not count; without any outcome every mean is `unknown`; equal rows get equal
verdicts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.llm.common import cut_lineage

LEAST = 0.5
Z = 1.645
#: Mean without any outcome, and the bounds of the estimated overdispersion.
UNKNOWN = 0.5
RHO_LOW, RHO_HIGH = 0.001, 0.5

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr",
    "com.tw", "edu.au", "gov.au", "gov.uk", "net.au", "or.jp", "org.au", "org.uk",
)

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix; the port does not count, an address is its own domain."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    address = name.rlike(r"^[0-9.]+$") | name.startswith("[")
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    suffix = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    long = F.regexp_extract(name, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    domain = F.when(two.isin(*TWO_LABEL_SUFFIXES), F.when(long != "", long).otherwise(name)).otherwise(F.when(two != "", two).otherwise(name))
    return F.when(address, name).otherwise(domain), F.when(address, F.lit("")).otherwise(suffix)


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    _, rule_host, rule_path = rule
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = _fits(host, path, rule)
        name, verdict = F.when(fits, rule[1] + rule[2]).otherwise(name), F.when(fits, rule[0]).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame) -> float:
    """Prior strength (1 - rho) / rho of a level, from (n, k, above): its groups around the means above them."""
    known = groups.where("n > 0 and above > 0 and above < 1")
    part = (F.col("k") - F.col("n") * F.col("above")) * (F.col("k") - F.col("n") * F.col("above")) / (F.col("n") * F.col("above") * (1 - F.col("above")))
    row = known.agg(F.sum(part).alias("chi"), F.count(F.lit(1)).alias("g"), F.sum("n").alias("n")).first()
    rho = (row["chi"] - row["g"]) / (row["n"] - row["g"]) if row["g"] and row["n"] > row["g"] else RHO_LOW
    rho = min(max(rho, RHO_LOW), RHO_HIGH)
    return (1 - rho) / rho


def _shrink(groups: DataFrame) -> tuple[DataFrame, float]:
    """The level's posterior means, as column mean, and its prior strength."""
    strength = _strength(groups)
    return groups.withColumn("mean", (F.col("k") + strength * F.col("above")) / (F.col("n") + strength)), strength


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, good, mean, lower) of every host. `pages`: (page_id, host); `outcomes`: (page_id, good 0 or 1)."""
    told = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.avg("good").alias("good"))
    seen = pages.join(told, "page_id", "left")
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = seen.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("k")).withColumns({"domain": domain, "suffix": suffix})
    hosts = cut_lineage(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(F.sum("k") / F.nullif(F.sum("n"), F.lit(0).cast("bigint"))).first()[0]
    suffixes, _ = _shrink(suffixes.withColumn("above", F.lit(UNKNOWN if whole is None else whole)))
    domains, _ = _shrink(cut_lineage(domains.join(suffixes.select("suffix", F.col("mean").alias("above")), "suffix")))
    hosts, strength = _shrink(cut_lineage(hosts.join(domains.select("domain", "suffix", F.col("mean").alias("above")), ["domain", "suffix"])))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1))
    return hosts.select("host", "n", F.col("k").alias("good"), "mean", (F.col("mean") - z * deviation).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), least: float = LEAST, z: float = Z) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = cut_lineage(reputations(rows.select("page_id", "host"), outcomes, z).select("host", "lower"))
    rule, told = first_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") >= least, "allow").otherwise("block")
    return rows.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(told, own).alias("verdict"))
