"""The default-deny serving gate: the only source of pages for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def servable(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Pages of active domains that are not suppressed and whose tier and verdict let them be served.

    Pushes the page predicate below the join; domains are a dimension and join on host.
    """
    live = pages.filter(~F.col("suppressed")).join(domains.filter("status = 'active'").drop("status"), "host")
    verdict = F.coalesce("verdict", F.lit("unclassified"))
    return live.filter((F.col("tier") == "T1") | ((F.col("tier") == "T2") & (verdict != "unsafe")) | ((F.col("tier") == "T3") & (verdict == "safe")))


def zone_a(pages: DataFrame, domains: DataFrame) -> DataFrame:
    return servable(pages, domains).filter("tier = 'T1' AND zone_a_eligible")


def zone_b(pages: DataFrame, domains: DataFrame) -> DataFrame:
    return servable(pages, domains).filter("tier IN ('T2', 'T3')")


def why_not(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Every page with the first reason for which it is not served (null: it is)."""
    joined = pages.join(domains, "host", "left")
    verdict = F.coalesce("verdict", F.lit("unclassified"))
    return joined.withColumn(
        "reason",
        F.when(F.col("suppressed"), "suppressed")
        .when(F.col("status").isNull(), "unknown domain")
        .when(F.col("status") != "active", "domain is not active")
        .when(F.col("tier") == "T0", "domain is in quarantine")
        .when((F.col("tier") == "T2") & (verdict == "unsafe"), "judged unsafe")
        .when((F.col("tier") == "T3") & (verdict != "safe"), "not judged safe"),
    )


def violations(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Acceptance invariants: one row per rule with the number of pages that break it (all should be 0)."""
    served = servable(pages, domains)
    rules = {
        "quarantined page served": F.col("tier") == "T0",
        "unsafe open-web page served": (F.col("tier") == "T3") & (F.coalesce("verdict", F.lit("")) != "safe"),
        "unsafe approved page served": (F.col("tier") == "T2") & (F.coalesce("verdict", F.lit("")) == "unsafe"),
        "suppressed page served": F.col("suppressed"),
    }
    counts = served.agg(*(F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    return counts.unpivot([], list(rules), "rule", "broken").select("rule", F.col("broken").cast("bigint").alias("broken"))
