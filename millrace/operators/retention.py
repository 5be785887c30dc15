"""Operators over the append-only event log: retention, limits, follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dry_run(log: DataFrame, identity: str, ts: str, anonymise_before: Column, delete_before: Column) -> DataFrame:
    """action, n: how many rows each retention step would touch, in one pass."""
    counts = log.agg(
        F.count_if((F.col(ts) < anonymise_before) & F.col(identity).isNotNull()).alias("anonymise"),
        F.count_if((F.col(ts) < delete_before) & F.col(identity).isNull()).alias("delete"),
    )
    return counts.unpivot([], ["anonymise", "delete"], "action", "n")


def applied(log: DataFrame, identity: str, ts: str, anonymise_before: Column, delete_before: Column) -> DataFrame:
    """The log without identities before one cutoff and without anonymous rows before another."""
    kept = log.filter(~((F.col(ts) < delete_before) & F.col(identity).isNull()))
    return kept.withColumn(identity, F.when(F.col(ts) < anonymise_before, F.lit(None)).otherwise(F.col(identity)))


def rate_limited(log: DataFrame, key: str, ts: str, seconds: int, most: int, tie: str | None = None) -> DataFrame:
    """``log`` plus refused: whether a key had more than ``most`` requests in the ``seconds`` up to and with this one.

    With ``tie`` (what orders equal times) also retry_after_s: seconds until the request ``most`` places before has left the window.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__at").rangeBetween(-seconds * 1_000_000, 0)
    out = log.withColumn("__at", at).withColumn("refused", F.count(F.lit(1)).over(w) > most)
    if tie is not None:
        before = F.lag("__at", most).over(Window.partitionBy(key).orderBy("__at", tie))
        out = out.withColumn("retry_after_s", F.when(F.col("refused"), F.ceil(seconds - (F.col("__at") - before) / 1_000_000.0).cast("bigint")))
    return out.drop("__at")


def nth_report(log: DataFrame, key: str, ts: str, tie: str, n: int) -> DataFrame:
    """Keys with at least ``n`` rows, how many, and when the ``n``-th came."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    ranked = log.withColumn("__k", F.row_number().over(w))
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("reports"), F.min(F.when(F.col("__k") == n, F.col(ts))).alias("at")).filter(F.col("reports") >= n)


def first_follow_up(first: DataFrame, then: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """``first`` plus ``at``: the earliest ``then`` row of the same keys within an interval (null: none).  An as-of join by key:
    both sides meet in one sorted window per key, without pairing them."""
    span = F.expr(f"INTERVAL {within}")
    a = first.withColumn("__then", F.lit(None).cast(then.schema[ts].dataType))
    b = then.select(*(F.lit(None).cast(first.schema[c].dataType).alias(c) if c not in (*keys, ts) else F.col(c) for c in first.columns)).withColumn("__then", F.col(ts))
    # From the end on, so that the running value is carried along row by row.
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col("__own").asc()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.withColumn("__own", F.lit(True)).unionByName(b.withColumn("__own", F.lit(False)))
    found = both.withColumn("__next", F.last("__then", ignorenulls=True).over(w)).filter("__own")
    return found.withColumn("at", F.when(F.col("__next") <= F.col(ts) + span, F.col("__next"))).drop("__then", "__next", "__own")


def latest(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """State of an append-only table of changes: the last row of each key."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return events.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def audited(events: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """``events`` plus old_value: what the key held before."""
    w = Window.partitionBy(*key).orderBy(*order)
    return events.withColumn("old_value", F.lag(value).over(w))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of those of the same key; to be written beside and swapped in."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.dropDuplicates(key))


def replaced_children(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """All children of the parents in ``new`` replaced by its rows."""
    return old.join(new.select(*parent).distinct(), parent, "left_anti").unionByName(new)


def vanished(known: DataFrame, seen: DataFrame, key: list[str], complete: bool = True) -> DataFrame:
    """Rows of ``known`` that a complete walk did not see; nothing from an incomplete or empty one."""
    if not complete or not seen.limit(1).count():
        return known.limit(0)
    return known.join(seen.select(*key).distinct(), key, "left_anti")


def changed(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """``new`` plus change: added, changed or same, by digest."""
    before = old.select(*key, F.col(digest).alias("__old"))
    joined = new.join(before, key, "left")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__old").eqNullSafe(F.col(digest)), "same").otherwise("changed")
    return joined.withColumn("change", change).drop("__old")
