"""Url verdicts from rules and from shrunken host reputations.

A host's share of bad pages is estimated by beta-binomial models in a chain: all pages, suffix,
registered domain, host. Each level's prior has the mean of the level above and a strength that is
fitted by moments over all groups of the level, so a host with few pages leans on its domain and one
with many on itself. A host is blocked when the lower bound of its posterior share is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecoframe.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BAD = 0.2  # share of bad pages that a host may surely exceed
Z = 1.6448536269514722  # one-sided 95 %
RHO_RANGE = (0.001, 0.95)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as text; both empty without ``://`` (or for null)."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substr(url, begin + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def registered_domain(host: Column) -> Column:
    """The last two labels, without user and port."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    return F.substring_index(name, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(registered_domain(host), ".", -1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    rule_case = verdict_case = F  # both start as functions.when
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))
        rule_case = rule_case.when(fits, rule)
        verdict_case = verdict_case.when(fits, rules[rule])
    none = F.lit(None).cast("string")
    return (rule_case, verdict_case) if rules else (none, none)


def _strength(groups: DataFrame, parent: str) -> float:
    """Prior strength of a level, from the spread of its groups around their parents' means."""
    m = F.col(parent)
    excess = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2) - m * (1 - m))
    scale = F.sum((F.col("n") - 1) * m * (1 - m))
    row = groups.where("n > 0").agg(excess.alias("e"), scale.alias("s")).first()
    rho = row.e / row.s if row.s else RHO_RANGE[1]
    rho = min(max(rho, RHO_RANGE[0]), RHO_RANGE[1])
    return 1 / rho - 1


def _posterior(groups: DataFrame, parent: str, out: str) -> DataFrame:
    strength = _strength(groups, parent)
    return groups.withColumn(out, (F.col("bad") + strength * F.col(parent)) / (F.col("n") + strength)).withColumn(
        f"{out}_weight", F.col("n") + F.lit(strength)
    )


def host_reputation(outcomes: DataFrame, host: str = "host", bad: str = "bad") -> DataFrame:
    """(host, n, bad, mean, lower, upper): posterior share of bad pages per host.

    ``bad`` is 1, 0 or null (not labelled). Hosts without labels get their domain's estimate; an
    empty table gives an empty result. The null host is read as the empty one.
    """
    hosts = materialise(
        outcomes.groupBy(F.coalesce(host, F.lit("")).alias("host")).agg(
            F.count(bad).alias("n"), F.coalesce(F.sum(F.col(bad).cast("long")), F.lit(0)).alias("bad")
        ),
        "hosts",
    ).withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("host")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total.bad or 0) + 1) / ((total.n or 0) + 2)
    count = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = _posterior(hosts.groupBy("suffix").agg(*count).withColumn("m0", F.lit(overall)), "m0", "m1")
    domains = hosts.groupBy("suffix", "domain").agg(*count).join(suffixes.select("suffix", "m1"), "suffix")
    domains = _posterior(domains, "m1", "m2")
    judged = _posterior(hosts.join(domains.select("suffix", "domain", "m2"), ["suffix", "domain"]), "m2", "mean")
    spread = Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("mean_weight") + 1))
    return judged.select(
        "host", "n", "bad", "mean",
        F.greatest(F.lit(0.0), F.col("mean") - spread).alias("lower"),
        F.least(F.lit(1.0), F.col("mean") + spread).alias("upper"),
    )


def symbol_outcome(html: Column, share: float = 0.03) -> Column:
    """1 if over ``share`` of the characters of a page are # $ % or *, else 0; null for null or empty."""
    left = F.length(F.translate(html, "#$%*", ""))
    return F.when(F.length(html) > 0, (F.length(html) - left > share * F.length(html)).cast("int"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], url: str = "url", max_bad: float = MAX_BAD) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the host's posterior (bad_mean, bad_lower).

    ``outcomes`` has columns host and bad. The longest fitting rule decides; otherwise a host is
    blocked if the lower bound of its share of bad pages is over ``max_bad``. Hosts without any
    outcome are allowed. A null url has empty host and path. Columns of ``pages`` with a result's
    name are replaced; repeated rows are kept.
    """
    new = ["host", "path", "rule", "verdict", "bad_mean", "bad_lower"]
    host, path = url_parts(F.col(url))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    kept = [F.col(c) for c in pages.columns if c not in new]
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("rule", rule).withColumn("_ruled", verdict)
    known = host_reputation(outcomes).select("host", F.col("mean").alias("bad_mean"), F.col("lower").alias("bad_lower"))
    by_host = F.when(F.col("bad_lower") > max_bad, "block").otherwise("allow")
    return (
        parsed.join(known, "host", "left")
        .withColumn("verdict", F.coalesce("_ruled", by_host))
        .select(*[c for c in pages.columns if c not in new], *new)
    )
