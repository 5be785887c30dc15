"""The crawl frontier as tables: what may be queued, who is due, who works on what, how runs end, what seeds a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.operators.shared import ranged, written

#: Claims older than this are taken as abandoned; attempts after which an item is left; failed runs in a row that pause a domain (fixed values).
STALE_MINUTES, MOST_ATTEMPTS, FAILED_RUNS = 60, 5, 3
#: Hours between visits at the least, by tier (fixed values).
FLOOR_HOURS = {"T1": 6, "T2": 24, "T3": 168}


def enqueued(links: DataFrame, domains: DataFrame, pages: DataFrame, queued: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(url, domain, place) to be queued and (url, domain, reason) refused.

    ``links``: url, domain, depth, source; ``domains``: domain, max_depth, interval_hours, max_pages; ``pages``: url, domain, fetched_at;
    ``queued``: url, domain.  A link is admitted by policy, made normal and distinct, and left out if it was fetched within the interval (unless asked
    for by hand or webhook) or is queued.  A domain takes what its page budget leaves, in order of URL.
    """
    judged = links.join(domains, "domain").withColumn("reason", U.refusal(F.col("url"), F.col("domain"), F.col("depth"), F.col("max_depth")))
    refused = judged.filter("reason IS NOT NULL").select("url", "domain", "reason")
    forced = F.max(F.col("source").isin("manual", "webhook")).alias("forced")
    unique = judged.filter("reason IS NULL").groupBy(U.normalized_url(F.col("url")).alias("url"), "domain", "interval_hours").agg(forced)
    seen = pages.select(U.normalized_url(F.col("url")).alias("url"), "domain", "fetched_at").groupBy("url", "domain").agg(F.max("fetched_at").alias("fetched_at"))
    fresh = (~F.col("forced")) & F.coalesce(F.col("fetched_at") > now - F.make_interval(hours=F.col("interval_hours")), F.lit(False))
    wanted = unique.join(seen, ["url", "domain"], "left").filter(~fresh).join(queued.select("url", "domain").distinct(), ["url", "domain"], "left_anti")
    used = pages.select("domain").unionByName(queued.select("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("used"))
    budget = domains.join(used, "domain", "left").select("domain", (F.col("max_pages") - F.coalesce("used", F.lit(0))).alias("budget"))
    placed = ranged(wanted.select("url", "domain"), ["domain"], [F.col("url")], {"place": F.lit(1)})
    return placed.join(budget, "domain").filter(F.col("place") <= F.col("budget")).select("url", "domain", "place"), refused


def due(domains: DataFrame, now: Column) -> DataFrame:
    """Active crawled domains whose next visit is due, those never visited first within a tier, plus ``place``."""
    rows = domains.filter((F.col("status") == "active") & F.col("mode").isin("crawl", "hybrid") & (F.col("next_due").isNull() | (F.col("next_due") <= now)))
    return ranged(rows, ["tier"], [F.col("next_due").asc_nulls_first(), F.col("host")], {"place": F.lit(1)})


def claimable(queue: DataFrame, now: Column) -> DataFrame:
    """Unclaimed items that are scheduled and have attempts left."""
    return queue.filter(F.col("claimed_by").isNull() & (F.col("scheduled_for") <= now) & (F.col("attempts") < MOST_ATTEMPTS))


def released(queue: DataFrame, deferred: Column, delay: Column, error: Column, now: Column) -> DataFrame:
    """``queue`` with ``deferred`` items unclaimed and put off, their error kept to 500 characters, and stale claims given up."""
    stale = F.col("claimed_at") < now - F.make_interval(mins=F.lit(STALE_MINUTES))
    free = deferred | F.coalesce(stale, F.lit(False))
    return queue.withColumns(
        {
            "scheduled_for": F.when(deferred, now + delay).otherwise(F.col("scheduled_for")),
            "last_error": F.when(deferred, F.substring(error, 1, 500)).otherwise(F.col("last_error")),
            "claimed_by": F.when(~free, F.col("claimed_by")),
            "claimed_at": F.when(~free, F.col("claimed_at")),
        }
    )


def finished(runs: DataFrame, order: list[str]) -> DataFrame:
    """key, runs, failed_in_row, unchanged_in_row, paused: how each domain's log of runs (key, changed, failed) ends.

    A run fails if it has failures and no change; three in a row pause the domain.
    """
    bad, same = (F.col("failed") > 0) & (F.col("changed") == 0), F.col("changed") == 0
    place = F.struct(*order)
    ends = runs.groupBy("key").agg(F.count(F.lit(1)).alias("runs"), F.max(F.when(~bad, place)).alias("__good"), F.max(F.when(~same, place)).alias("__new"))
    met = runs.join(ends, "key")
    after = lambda mark: F.count_if(F.col(mark).isNull() | (place > F.col(mark)))
    out = met.groupBy("key", "runs").agg(after("__good").alias("failed_in_row"), after("__new").alias("unchanged_in_row"))
    return out.withColumn("paused", F.col("failed_in_row") >= FAILED_RUNS)


def seeded(roots: DataFrame, listed: DataFrame, most: int = 5) -> DataFrame:
    """url, depth: pages reached from ``roots`` (url) through nested sitemap indexes (``listed``: sitemap, url, kind ``index`` or ``page``).

    Breadth first, ``most`` levels at the most; a sitemap that was read is not read again, so circles end.
    """
    front, read, found, depth = roots.select("url").distinct(), None, None, 0
    while depth < most:
        depth += 1
        below = written(front.withColumnRenamed("url", "sitemap").join(listed, "sitemap").select("url", "kind").distinct(), "sitemaps")
        pages = below.filter("kind = 'page'").select("url", F.lit(depth).alias("depth"))
        found = pages if found is None else found.unionByName(pages)
        read = front if read is None else read.unionByName(front)
        front = written(below.filter("kind = 'index'").select("url").join(read, "url", "left_anti"), "front")
        if not front.limit(1).count():
            break
    return found.groupBy("url").agg(F.min("depth").alias("depth"))


def outcome(status: Column, allowed: Column, reason: Column, content_type: Column, size: Column, most_bytes: int = 5 << 20) -> Column:
    """What a fetch came to: robots, error, gone, retry, refused type, too large or ok."""
    return (
        F.when(~allowed, "robots")
        .when(reason.isNotNull(), "error")
        .when(status.isin(404, 410), "gone")
        .when((status == 429) | (status >= 500), "retry")
        .when(status == 304, "unchanged")
        .when(status >= 400, "error")
        .when(U.content_type_refusal(content_type).isNotNull(), "refused type")
        .when(size > most_bytes, "too large")
        .otherwise("ok")
    )


def wait_ms(attempt: Column, jitter: Column, retry_after: Column, base: int = 1000, cap: int = 600_000) -> Column:
    """The wait before the next attempt: what the server asked for (seconds) if it did, else backoff with jitter; ten minutes at most."""
    return F.least(F.lit(float(cap)), F.coalesce(retry_after * 1000.0, U.backoff_ms(attempt, jitter, base, cap)))


def failures(log: DataFrame) -> DataFrame:
    """url, attempts, errors, last_outcome: an append-only log of fetches; only outcome ``error`` counts as a failure."""
    last = F.max_by("outcome", F.struct("at", "id"))
    return log.groupBy("url").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome") == "error").alias("errors"), last.alias("last_outcome"))


def latest_of(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key, plus ``place``; the window is cut to the rank before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
