"""Retrieval evaluation: recall, threshold curves, blends, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.shared import ranged


def recall(ranks: DataFrame, by: str) -> DataFrame:
    """n, recall at 1, 3, 5 and 10, mean reciprocal rank and median rank per group; a null rank was not found."""
    share = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return ranks.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(share(k) for k in (1, 3, 5, 10)), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rank)").alias("median_rank"))


def threshold_curve(rows: DataFrame) -> DataFrame:
    """For each distinct score as a floor: wanted rows kept and lost, others admitted and blocked.

    Counted per score first; running totals then go over ranges of distinct scores, what a floor keeps being all but what lies below.
    """
    counts = rows.groupBy("score").agg(F.count_if("wanted").alias("w"), F.count_if(~F.col("wanted")).alias("o")).withColumn("g", F.lit(0))
    summed = ranged(counts, ["g"], [F.col("score")], {"w_upto": F.col("w"), "o_upto": F.col("o")})
    whole = rows.agg(F.count_if("wanted").alias("w_all"), F.count_if(~F.col("wanted")).alias("o_all"))
    below = lambda c: F.col(f"{c}_upto") - F.col(c)
    return summed.crossJoin(F.broadcast(whole)).select(  # one row
        F.col("score").cast("double").alias("floor"),
        (F.col("w_all") - below("w")).alias("kept"),
        below("w").alias("lost"),
        (F.col("o_all") - below("o")).alias("admitted"),
        below("o").alias("blocked"),
    )


def gate_sweep(rows: DataFrame, floors: list[float]) -> DataFrame:
    """floor, emptied, positives_lost: of queries that have an answer and of those that have none, how many a vector gate empties at each floor.

    ``rows``: query_id, wanted (whether the query has an answer), best (the best cosine of its first five).
    """
    each = rows.withColumn("floor", F.explode(F.array(*map(F.lit, floors))))
    emptied = F.coalesce(F.col("best") < F.col("floor"), F.lit(True))
    return each.groupBy("floor").agg(F.count_if(emptied & ~F.col("wanted")).alias("emptied"), F.count_if(emptied & F.col("wanted")).alias("positives_lost"))


def rerank_effect(rows: DataFrame, top: int = 10) -> DataFrame:
    """type, n, with_rerank, without, helped, hurt: pairs found among the first ``top`` by two ranks (``on``, ``off``; null: not found)."""
    on, off = (F.coalesce(F.col(c) <= top, F.lit(False)) for c in ("on", "off"))
    return rows.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(on).alias("with_rerank"), F.count_if(off).alias("without"), F.count_if(on & ~off).alias("helped"), F.count_if(off & ~on).alias("hurt")
    )


def preflight(models: DataFrame, configured: str, dimension: int) -> DataFrame:
    """check, ok: one model in the store, of the wanted dimension, and the one that is configured; an evaluation refuses to run unless all hold.

    ``models``: model, dimension, one row a vector.
    """
    facts = models.agg(F.countDistinct("model").alias("n"), F.min("model").alias("model"), F.min("dimension").alias("lo"), F.max("dimension").alias("hi"))
    checks = {"one model": F.col("n") == 1, "dimension": (F.col("lo") == dimension) & (F.col("hi") == dimension), "configured model": (F.col("n") == 1) & (F.col("model") == configured)}
    held = facts.select(*(F.coalesce(ok, F.lit(False)).alias(name) for name, ok in checks.items()))
    return held.unpivot([], list(checks), "check", "ok")


def reconciled(live: DataFrame, restored: DataFrame) -> DataFrame:
    """name, live, restored of tables whose row counts differ after a restore."""
    a, b = live.select("name", F.col("n").alias("live")), restored.select("name", F.col("n").alias("restored"))
    return a.join(b, "name", "full").filter(~F.col("live").eqNullSafe(F.col("restored")))


def blend(rows: DataFrame, weights: list[float], top: int) -> DataFrame:
    """w, good: wanted rows among the best ``top`` of (1 - w) * a + w * b, for each weight."""
    each = rows.withColumn("w", F.explode(F.array(*map(F.lit, weights))))
    score = F.round((1 - F.col("w")) * F.col("a") + F.col("w") * F.col("b"), 9)
    order = Window.partitionBy("w").orderBy(score.desc(), "doc_id")
    best = each.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top)
    return best.groupBy("w").agg(F.sum("quality").cast("bigint").alias("good"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """pair, change (gained, lost, moved, same) between two runs."""
    a, b = before.withColumnRenamed("rank", "r_a"), after.withColumnRenamed("rank", "r_b")
    change = F.when(F.col("r_a").isNull(), "gained").when(F.col("r_b").isNull(), "lost").when(F.col("r_a") != F.col("r_b"), "moved").otherwise("same")
    return a.join(b, "pair", "full").withColumn("change", change)


def verdict(rank: Column) -> Column:
    return F.when(rank.isNull(), "RETRIEVAL").when(rank <= 50, "RANKING").otherwise("DEEP")
