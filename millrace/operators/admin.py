"""Administration as folds of append-only events: domains, pins, terms, decisions, candidates, purges, caches, verdicts of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.retention import latest

#: Limits and floors by tier (fixed values): pages a domain may have, depth, zone.
TIERS = [("T1", 50_000, 8, "A"), ("T2", 20_000, 6, "B"), ("T3", 2_000, 4, "B"), ("T0", 20, 2, None)]
#: Heads of a toxicity model: from which score each is a flag (fixed values).
HEADS = {"toxic": 0.8, "severe_toxic": 0.5, "obscene": 0.5, "threat": 0.5, "insult": 0.5, "identity_hate": 0.5}
UMBRELLA_LESS, TOPIC_FLAG, TOPIC_MASS = 0.3, 0.5, 0.6


def folded(events: DataFrame, key: list[str], order: list[str], action: str = "action", gone: tuple[str, ...] = ("delete",)) -> DataFrame:
    """State of a table kept as events: the last row of each key, without keys whose last event takes them away."""
    return latest(events, key, order).filter(~F.col(action).isin(*gone))


def filled(events: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """State of a table edited field by field: the last value that is not null of each field."""
    at = F.struct(*order)
    return events.groupBy(*key).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields))


def edited(domains: DataFrame, edits: DataFrame, allowed: list[str]) -> DataFrame:
    """``domains`` (host, tier, zone_a_eligible, status, ...) after edits (host, field, value, at); fields not ``allowed`` are left alone.

    A domain that leaves the first tier is no longer eligible for Zone A.
    """
    last = latest(edits.filter(F.col("field").isin(*allowed)), ["host", "field"], ["at"])
    wide = last.groupBy("host").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"__{f}") for f in allowed))
    met = domains.join(wide, "host", "left")
    out = met.withColumns({f: F.coalesce(F.col(f"__{f}").cast(domains.schema[f].dataType), F.col(f)) for f in allowed}).select(*domains.columns)
    return out.withColumn("zone_a_eligible", F.col("zone_a_eligible") & (F.col("tier") == "T1"))


def verified(domains: DataFrame, proofs: DataFrame) -> DataFrame:
    """``domains`` with those active and eligible for Zone A whose token was proved by one of the three methods (proofs: host, method, token)."""
    good = proofs.filter(F.col("method").isin("dns", "well-known", "meta")).select("host", "token").distinct().withColumn("__ok", F.lit(True))
    met = domains.join(good, ["host", "token"], "left")
    ok = F.coalesce("__ok", F.lit(False))
    return met.withColumns({"verified": ok, "zone_a_eligible": ok | F.col("zone_a_eligible"), "status": F.when(ok, "active").otherwise(F.col("status"))}).drop("__ok")


def purged(tables: dict[str, DataFrame], tombstones: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the keys in ``tombstones``: a delete that cascades."""
    gone = tombstones.select(key).distinct()
    return {name: rows.join(gone, key, "left_anti") for name, rows in tables.items()}


def rule_error(pattern: Column, kind: Column, severity: Column) -> Column:
    """Why a safety rule may not be added by hand (null: it may): bounds, kinds, and no outright block by one word."""
    return (
        F.when(F.coalesce(F.trim(pattern), F.lit("")) == "", "empty pattern")
        .when(~kind.isin("host", "suffix", "keyword"), "unknown kind")
        .when(~severity.between(0, 100), "severity out of range")
        .when((kind == "keyword") & (severity >= 100) & ~F.contains(F.trim(pattern), F.lit(" ")), "one word may not block")
    )


def pin_error(pattern: Column, blurb: Column, starts: Column, ends: Column) -> Column:
    """Why an editorial pin is refused (null: it is not)."""
    return (
        F.when(F.length(F.trim(F.coalesce(pattern, F.lit("")))) < 2, "pattern too short")
        .when(F.length(blurb) > 160, "blurb too long")
        .when(starts.isNotNull() & ends.isNotNull() & (ends <= starts), "window ends before it starts")
    )


def cache_key(version: Column, params: dict[str, Column]) -> Column:
    """Key of a result cache: a digest of the index version and the parameters in order of name, nulls left out."""
    parts = [F.when(params[k].isNotNull(), F.concat(F.lit(f"{k}="), params[k].cast("string"))) for k in sorted(params)]
    return F.sha2(F.concat_ws("&", F.concat(F.lit("v="), version.cast("string")), *parts), 256)


def live_entries(cache: DataFrame, now: Column, ttl_minutes: Column, version: Column) -> DataFrame:
    """Entries of a cache that are neither past their time nor of another index version; the last write of a key stands."""
    fresh = cache.filter((F.col("version") == version) & (F.col("at") > now - F.make_interval(mins=ttl_minutes)))
    return latest(fresh, ["key"], ["at"])


def family_verdict(heads: dict[str, Column], topics: list[tuple[str, Column, bool]], threshold: float = TOPIC_FLAG) -> dict[str, Column]:
    """safe, confidence and flags of a page from toxicity heads and topic scores (label, score, whether the topic is unsafe).

    A head at its bar is a flag.  So is the best topic if it is unsafe and reaches ``threshold``, or if the unsafe topics together reach
    ``TOPIC_MASS``.  Confidence is that in the verdict given: the strongest evidence against, or how little of it there is.
    """
    hits = [F.when(F.coalesce(heads[h], F.lit(0.0)) >= bar, h) for h, bar in HEADS.items() if h in heads]
    level = [F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)) - (UMBRELLA_LESS if h == "toxic" else 0.0)) for h, c in heads.items()]
    strongest = F.greatest(F.lit(0.0), F.lit(0.0), *level)
    best = F.array_max(F.array(*(F.struct(F.coalesce(s, F.lit(0.0)).alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("label"), F.lit(bad).alias("bad")) for k, (name, s, bad) in enumerate(topics))))
    mass = sum((F.coalesce(s, F.lit(0.0)) for _, s, bad in topics if bad), F.lit(0.0))
    topic = best["bad"] & ((best["score"] >= threshold) | (mass >= TOPIC_MASS))
    flags = F.array_compact(F.array(*hits, F.when(topic, best["label"])))
    unsafe = F.size(flags) > 0
    against = F.least(F.lit(1.0), F.greatest(strongest, F.when(topic, best["score"]).otherwise(0.0)))
    confidence = F.when(unsafe, against).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(strongest, mass)))
    return {"safe": ~unsafe, "confidence": F.round(confidence, 3), "flags": F.array_join(flags, ",")}


def sampled(rows: DataFrame, key: str, percent: float, seed: str) -> DataFrame:
    """About ``percent`` of the rows, at least one, the same in every run: those whose keys hash lowest."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    hashed = rows.withColumn("__h", h)
    least = hashed.agg(F.min("__h").alias("__least"))  # one row
    kept = hashed.crossJoin(F.broadcast(least)).filter((F.col("__h") < int(percent / 100 * 2**32)) | (F.col("__h") == F.col("__least")))
    return kept.drop("__h", "__least")
