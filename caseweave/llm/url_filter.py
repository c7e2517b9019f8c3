"""URL filters: rules by host and path, and an empirical-Bayes reputation of hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import hot_rows, join_hot, stage

#: Second-level names under a two-letter country code that make a suffix of two labels, unless others are given (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no "://"."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct(rule, verdict), or null. Of equally long ones the first in alphabetical order wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own_host, own_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        found = F.when(fits, F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def domain_parts(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, by rule: the suffix is the last label, or the last two where the one before a country code is in `second_level`; the domain has one more. Ports and user names are left out."""
    labels = F.split(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", ""), r"\.")
    n = F.size(labels)
    last = F.element_at(labels, -1)
    two = (n >= 3) & (F.length(last) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*second_level)
    size = F.when(two, 2).otherwise(1)
    suffix = F.array_join(F.slice(labels, F.greatest(n - size + 1, F.lit(1)), 3), ".")
    return F.array_join(F.slice(labels, F.greatest(n - size, F.lit(1)), 4), "."), suffix


def _shrunk(groups: DataFrame, key: str, mean: str) -> DataFrame:
    """Shrink the outcomes (k bad of n) of each group to the prior mean in column `mean`.

    One strength a level, by moments of the beta-binomial: the squared deviations beyond the binomial's over
    n (n - 1) m (1 - m) are the correlation within a group, held between 0.001 and 0.9.
    """
    m = F.col(mean)
    spread = m * (1 - m)
    over = F.sum((F.col("k") - F.col("n") * m) * (F.col("k") - F.col("n") * m) - F.col("n") * spread)
    room = F.sum(F.col("n") * (F.col("n") - 1) * spread)
    moments = groups.agg(over.alias("_over"), room.alias("_room"))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.9), F.coalesce(F.when(F.col("_room") > 0, F.col("_over") / F.col("_room")), F.lit(0.001))))
    strength = moments.select(((1 - rho) / rho).alias("_strength"))
    joined = groups.withColumn("_strength", strength.scalar())
    a = m * F.col("_strength") + F.col("k")
    total = F.col("_strength") + F.col("n")
    return joined.withColumn(f"{key}_mean", a / total).withColumn(f"{key}_size", total).drop("_strength")


def reputation(outcomes: DataFrame, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """host, pages, n, host_mean and host_sd of every host in outcomes (host, bad: 1, 0 or null if not labelled).

    A host's rate of bad pages is shrunk to its registered domain's, that one's to its suffix's, and that to
    the rate over all. host_sd is the posterior's standard deviation. Each level is counted from the staged one below.
    """
    hosts = outcomes.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"), F.count("bad").cast("double").alias("n"), F.count("*").alias("pages"))
    domain, suffix = domain_parts(F.col("host"), second_level)
    hosts = stage(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = stage(hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "domains")
    suffixes = stage(domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "suffixes")
    whole = suffixes.agg(F.coalesce((F.sum("k") + 1) / (F.sum("n") + 2), F.lit(0.5)).alias("_all"))
    suffixes = _shrunk(suffixes.withColumn("_all", whole.scalar()), "suffix", "_all").select("suffix", "suffix_mean")
    domains = stage(domains.join(stage(suffixes, "suffixes"), "suffix"), "domains")
    domains = _shrunk(domains, "domain", "suffix_mean").select("domain", "suffix", "domain_mean")
    found = _shrunk(stage(hosts.join(domains, ["domain", "suffix"]), "hosts"), "host", "domain_mean")
    sd = F.sqrt(F.col("host_mean") * (1 - F.col("host_mean")) / (F.col("host_size") + 1))
    return found.select("host", "pages", "n", "host_mean", sd.alias("host_sd"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.5, z: float = 1.0, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """Verdict on every row of pages (page_id, url): the longest rule's, else "block" where the lower posterior bound of the host's bad rate is over `threshold`.

    outcomes: page_id and bad (1 or 0) of labelled pages, one row each or more. The bound is the posterior mean less `z` standard deviations. Adds host, path, rule and
    verdict; empty hosts are judged like any other. A host with a large share of the pages is joined by
    broadcast, of which there are at most a thousand.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = reputation(parts.select("page_id", "host").join(known, "page_id", "left").select("host", "bad"), second_level)
    bad = F.col("host_mean") - z * F.col("host_sd") > threshold
    verdicts = stage(hosts.select("host", "pages", F.when(bad, "block").otherwise("allow").alias("_own")), "verdicts")
    joined = join_hot(parts, verdicts, "host", F.col("pages"), hot_rows(pages.count()))
    ruled = joined.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    return ruled.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "_own").alias("verdict"))
