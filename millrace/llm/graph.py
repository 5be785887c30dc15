"""Connected components of a link table, by contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common


def components(links: DataFrame) -> DataFrame:
    """``id``, ``label`` (smallest id reachable) of every id in ``links`` (a, b).

    Each round every id points to its smallest neighbour (pre-aggregated before the shuffle), pointers are followed
    twice more, and links are rewritten between the ids pointed to; links inside a
    contracted group vanish, so the work shrinks round by round.  Every round is written to the
    shared folder, and only whether links are left reaches the driver.
    """
    left = common.written(_ordered(links, "a", "b"), "links")
    labels = None
    while True:
        point = left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
        # The smaller end of a link may have no smaller neighbour itself: it points to itself.
        further = point.select(F.col("id").alias("to"), F.col("to").alias("then"))
        point = common.written(point.join(further, "to", "left").select("id", F.coalesce("then", "to").alias("to")), "pointers")
        further = point.select(F.col("id").alias("to"), F.col("to").alias("then"))
        point = common.written(point.join(further, "to", "left").select("id", F.coalesce("then", "to").alias("to")), "pointers")
        if labels is None:
            roots = left.select(F.col("a").alias("id")).distinct().join(point, "id", "left_anti")
            labels = point.select("id", F.col("to").alias("label")).unionByName(roots.select("id", F.col("id").alias("label")))
        else:
            step = point.select(F.col("id").alias("label"), F.col("to").alias("then"))
            labels = labels.join(step, "label", "left").select("id", F.coalesce("then", "label").alias("label"))
        labels = common.written(labels, "labels")
        a = point.select(F.col("id").alias("a"), F.col("to").alias("a_to"))
        b = point.select(F.col("id").alias("b"), F.col("to").alias("b_to"))
        moved = left.join(a, "a", "left").join(b, "b", "left")
        left = common.written(_ordered(moved.select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y")), "x", "y"), "links")
        if not left.limit(1).count():
            return labels


def _ordered(links: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct links with the smaller end in ``a``, none from an id to itself."""
    return links.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
