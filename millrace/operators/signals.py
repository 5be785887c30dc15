"""Click signals, gaps and reports over the impression and query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.shared import ranged

#: Probability that a position is looked at, by zone (fixed values, seeded until measured).
EXAMINED = {
    "A": [1.0, 0.68, 0.5, 0.39, 0.31],
    "B": [0.55, 0.4, 0.31, 0.25, 0.21, 0.18, 0.155, 0.135, 0.12, 0.105],
}


def position_bias(spark: SparkSession) -> DataFrame:
    rows = [(zone, k, p) for zone, values in EXAMINED.items() for k, p in enumerate(values, 1)]
    return spark.createDataFrame(rows, "zone string, position int, examined double")


def ctr_rollup(impressions: DataFrame, bias: DataFrame, least: int = 5) -> DataFrame:
    """query, page_id, n, clicks, raw and bias-corrected CTR, confidence.  Positions without a known bias drop out."""
    seen = impressions.join(F.broadcast(bias), ["zone", "position"])  # fifteen rows
    click = F.col("clicked").cast("int")
    return (
        seen.groupBy("query", "page_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(click).alias("clicks"),
            (F.sum(click / F.col("examined")) / F.sum(1 / F.col("examined"))).alias("corrected"),
        )
        .filter(F.col("n") >= least)
        .select(
            "query",
            "page_id",
            "n",
            "clicks",
            F.round(F.col("clicks") / F.col("n"), 6).alias("raw_ctr"),
            F.round("corrected", 6).alias("corrected_ctr"),
            F.round(F.least(F.col("n") / 50.0, F.lit(1.0)), 6).alias("confidence"),
        )
    )


def dropped_positions(impressions: DataFrame, bias: DataFrame) -> DataFrame:
    """Impressions that fall out of the roll-up for want of a bias, by zone and position."""
    return impressions.join(F.broadcast(bias), ["zone", "position"], "left_anti").groupBy("zone", "position").agg(F.count(F.lit(1)).alias("n"))


def ctr_movement(rollup: DataFrame) -> DataFrame:
    """Pages whose rank within a query differs between raw and corrected CTR."""
    raw = Window.partitionBy("query").orderBy(F.col("raw_ctr").desc(), "page_id")
    corrected = Window.partitionBy("query").orderBy(F.col("corrected_ctr").desc(), "page_id")
    ranked = rollup.withColumn("raw_rank", F.row_number().over(raw)).withColumn("corrected_rank", F.row_number().over(corrected))
    return ranked.filter("raw_rank <> corrected_rank").select("query", "page_id", "raw_rank", "corrected_rank", (F.col("raw_rank") - F.col("corrected_rank")).alias("moved"))


def strongest_pair(rollup: DataFrame) -> DataFrame:
    """For each page the query with most impressions."""
    best = F.max_by(F.struct("query", "n", "corrected_ctr"), F.struct(F.col("n"), F.col("query")))
    return rollup.groupBy("page_id").agg(best.alias("b")).select("page_id", "b.query", "b.n", "b.corrected_ctr")


def zone_ctr(impressions: DataFrame, least_seen: int = 500, least_clicks: int = 20) -> DataFrame:
    """zone, impressions, clicks, ctr, judged: whether there is enough to judge."""
    return (
        impressions.groupBy("zone")
        .agg(F.count(F.lit(1)).alias("impressions"), F.count_if("clicked").alias("clicks"))
        .withColumn("ctr", F.round(F.col("clicks") / F.col("impressions"), 6))
        .withColumn("judged", (F.col("impressions") >= least_seen) & (F.col("clicks") >= least_clicks))
    )


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``by`` and the exact quantiles ``wanted`` of ``value``: the least value that has at least that share of the group at or below it.

    Values are counted, range-sorted and their counts added up, so a large group is spread over all tasks.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    summed = ranged(counts, by, [F.col(value)], {"upto": F.col("n")})
    total = counts.groupBy(*by).agg(F.sum("n").alias("__total"))
    met = summed.join(total, by)
    return met.groupBy(*by).agg(*(F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("__total")), F.col(value))).alias(name) for name, q in wanted.items()))


def without_bursts(impressions: DataFrame, least: int = 20) -> DataFrame:
    """Impressions but the anonymous ones of a query and hour in which anonymous traffic reaches ``least``."""
    hour = F.date_trunc("hour", "ts")
    anonymous = impressions.filter(F.col("user_id").isNull())
    bursts = anonymous.groupBy("query", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("query", "hour")
    calm = anonymous.withColumn("hour", hour).join(bursts, ["query", "hour"], "left_anti").drop("hour")
    return impressions.filter(F.col("user_id").isNotNull()).unionByName(calm.select(*impressions.columns))


def demand(log: DataFrame, empty: Column, least: int) -> DataFrame:
    """Queries for which ``empty`` holds, asked at least ``least`` times."""
    return log.filter(empty).groupBy("query").agg(F.count(F.lit(1)).alias("asked"), F.countDistinct("session").alias("sessions")).filter(F.col("asked") >= least)


def engagement_score(dwell_ms: Column, scroll: Column, completion: Column, bounce: Column, views: Column) -> Column:
    """0 to 100; a missing measure adds nothing and weights are not dealt anew."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    measured = lambda c, value: F.when(c.isNotNull(), value)  # noqa: E731  least() would skip a null
    parts = [
        (0.30, measured(dwell_ms, clamp(dwell_ms / 180_000))),
        (0.25, measured(scroll, clamp(scroll / 100))),
        (0.20, measured(completion, clamp(completion / 100))),
        (0.15, measured(bounce, 1 - clamp(bounce / 100))),
        (0.10, measured(views, clamp(F.log10(1 + views) / F.log10(F.lit(1001.0))))),
    ]
    total = F.lit(0.0)
    for weight, part in parts:
        present = part.isNotNull()
        total = total + F.when(present, weight * part).otherwise(0.0)
    return F.round(100 * total, 2)


def quality_score(n_words: Column, flags: dict[str, Column], inlinks: Column, failures: Column) -> Column:
    """0 to 100 from length, present metadata (title, description, category, date, tags, author), inlinks and failures."""
    points = {"title": 10, "description": 8, "category": 6, "date": 6, "tags": 5, "author": 5}
    log_share = lambda c, top: F.least(F.lit(1.0), F.log(1 + F.coalesce(c, F.lit(0))) / F.log(F.lit(float(top))))
    total = 30 * log_share(n_words, 1201) + 20 * log_share(inlinks, 51) + F.when(F.coalesce(failures, F.lit(0)) == 0, 10).otherwise(0)
    for name, value in points.items():
        total = total + F.when(F.coalesce(flags[name], F.lit(False)), value).otherwise(0)
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 2)
