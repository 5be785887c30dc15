"""Structured Streaming over the event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    """A file stream of events with a watermark on ``at``."""
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def bursts(events: DataFrame, least: int = 20) -> DataFrame:
    """user_id, hour windows with at least ``least`` events."""
    return events.groupBy(F.window("at", "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def sliding(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("at", "1 hour", "15 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"))


def without_replays(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once within the watermark: replayed calls are dropped, and state is bounded."""
    return events.dropDuplicatesWithinWatermark([key])


def clicked(impressions: DataFrame, clicks: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Impressions with the click that follows within an interval, null once the watermark has passed it."""
    c = clicks.select(*(F.col(k).alias(f"c_{k}") for k in keys), F.col("at").alias("clicked_at"))
    same = [F.col(k) == F.col(f"c_{k}") for k in keys]
    span = (F.col("clicked_at") >= F.col("at")) & (F.col("clicked_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    condition = span
    for s in same:
        condition = condition & s
    return impressions.join(c, condition, "leftOuter")


class _Limiter(StatefulProcessor):
    """Counts reports of a key and says once when the limit is reached."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else 0
        n = before + sum(len(r) for r in rows)
        self.seen.update((n,))
        if before < self.limit <= n:
            yield pd.DataFrame({"user_id": [key[0]], "reports": [n]})

    def close(self) -> None:
        pass


def suppressions(events: DataFrame, limit: int = 3) -> DataFrame:
    """user_id, reports: keys as they reach the limit of error reports."""
    reports = events.filter("event_type = 'error'")
    return reports.groupBy("user_id").transformWithStateInPandas(_Limiter(limit), "user_id bigint, reports bigint", "Append", "None")


def high_water(stream: DataFrame, sink: str, checkpoint: str):
    """Appends a stream to Parquet; the checkpoint is the mark, moved only once a batch is written."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
