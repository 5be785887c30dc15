"""Safety gates, verdict ladder, trust graph, candidate lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls as U

#: Model confidence from which a page is safe, and from which it goes to review (fixed values).
SAFE, REVIEW = 0.90, 0.70
BLOCK = 100
STRIKES = 5


def blocked_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rule, severity: host rules (any parent domain) and suffix rules that hit; an allow rule (severity 0) clears a host.

    ``rules``: pattern, match_type, severity.  Rules are millions and join by equality: host rules with the parents of a host,
    suffix rules with every ending of it.
    """
    names = hosts.select("host").distinct()
    allowed = rules.filter("match_type = 'host' AND severity = 0").select(F.lower("pattern").alias("host"))
    judged = names.join(allowed, "host", "left_anti")
    by_host = rules.filter("match_type = 'host' AND severity > 0").select(F.lower("pattern").alias("rule"), "severity")
    hits = judged.select("host", F.explode(U.host_candidates(F.col("host"))).alias("rule")).join(by_host, "rule").select("host", "rule", "severity")
    suffix = rules.filter("match_type = 'suffix' AND severity > 0").select(F.lower("pattern").alias("rule"), "severity")
    endings = F.transform(F.sequence(F.lit(1), F.length("host")), lambda i: F.substring("host", i, F.length("host")))
    return hits.unionByName(judged.filter("host <> ''").select("host", F.explode(endings).alias("rule")).join(suffix, "rule").select("host", "rule", "severity"))


def keyword_score(text: Column, rules: list[tuple[str, int]]) -> Column:
    """Sum of the severities of the words found in a text."""
    out = F.lit(0)
    for word, severity in rules:
        out = out + F.when(F.contains(F.lower(text), F.lit(word.lower())), severity).otherwise(0)
    return out


def content_verdict(safe: Column) -> Column:
    """Verdict of the model's probability that a page is safe; no answer leaves it unclassified."""
    return F.when(safe.isNull(), "unclassified").when(safe >= SAFE, "safe").when(safe >= REVIEW, "review").otherwise("unsafe")


def ladder(tier: Column, host_severity: Column, words: Column, safe: Column) -> Column:
    """Owned pages pass; blocked hosts and words are unsafe; approved sites go to review on any word; the rest ask the model."""
    return (
        F.when(tier == "T1", "safe")
        .when(F.coalesce(host_severity, F.lit(0)) >= BLOCK, "unsafe")
        .when(words >= BLOCK, "unsafe")
        .when((tier == "T2") & (words > 0), "review")
        .when(tier == "T2", "safe")
        .otherwise(content_verdict(safe))
    )


def status_of(verdict: Column) -> Column:
    return F.when(verdict == "safe", "indexed").when(verdict.isin("review", "unclassified"), "quarantined").otherwise("rejected")


def struck_domains(verdicts: DataFrame, limit: int = STRIKES) -> DataFrame:
    """host, strikes of domains whose unsafe pages reach the limit: blocked, their pages purged."""
    return verdicts.filter("verdict = 'unsafe'").groupBy("host").agg(F.count(F.lit(1)).alias("strikes")).filter(F.col("strikes") >= limit)


def nominated(links: DataFrame, domains: DataFrame, decided: DataFrame, least: int = 3) -> DataFrame:
    """host, linking_domains, linking_hosts, samples: unknown hosts that enough trusted domains link to.

    ``links``: from_host, to_host, to_url, rel, is_internal.
    """
    trusted = domains.filter("tier IN ('T1', 'T2') AND status = 'active'").select(F.col("host").alias("from_host"))
    outside = links.filter((~F.col("is_internal")) & (F.coalesce("to_host", F.lit("")) != "") & ~F.contains(F.coalesce("rel", F.lit("")), F.lit("nofollow")))
    by_domain = outside.join(trusted, "from_host").groupBy("to_host", "from_host").agg(F.min("to_url").alias("sample"))
    known = domains.select(F.col("host").alias("to_host")).unionByName(decided.select(F.col("host").alias("to_host")))
    return (
        by_domain.join(known, "to_host", "left_anti")
        .groupBy(F.col("to_host").alias("host"))
        .agg(F.count(F.lit(1)).alias("linking_domains"), F.sort_array(F.collect_set("from_host")).alias("linking_hosts"), F.slice(F.sort_array(F.collect_list("sample")), 1, 5).alias("samples"))
        .filter(F.col("linking_domains") >= least)
    )


def probe_outcome(pages: DataFrame, least_pages: int = 5, rate: float = 0.9) -> DataFrame:
    """host, probed, passed, outcome of probed hosts: promoted, rejected, or waiting for more pages."""
    counts = pages.filter("verdict IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("probed"), F.count_if(F.col("verdict") == "safe").alias("passed"))
    ok = F.col("passed") / F.col("probed") >= rate
    return counts.withColumn("outcome", F.when(F.col("probed") < least_pages, "waiting").when(ok, "promoted").otherwise("rejected"))
