import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import retention as R
from millrace.streaming import events as V


@pytest.fixture()
def folder(spark, tmp_path):
    rows = pd.DataFrame(
        {
            "event_id": [1, 2, 3, 3, 4, 5, 99],
            "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:01", "2024-01-01 00:02", "2024-01-01 00:02", "2024-01-01 00:30", "2024-01-01 02:00", "2024-01-03 00:00"]),
            "user_id": [1, 1, 1, 1, 2, 1, 3],
            "event_type": ["error", "error", "error", "error", "view", "click", "view"],
            "value": 1.0,
            "props": '{"k": 1}',
        }
    )
    rows.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    return str(tmp_path)


def drained(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_replays_and_closed_windows_equal_batch(spark, folder):
    stream = V.event_stream(spark, folder)
    assert drained(V.without_replays(stream), "deduped").count() == 6
    found = {(r["user_id"], r["n"]) for r in drained(V.sessions(stream), "sessions").collect()}
    assert {(1, 4), (1, 1), (2, 1)} <= found
    assert {r["user_id"] for r in drained(V.bursts(stream, 4), "bursts").collect()} == {1}


def test_rate_limit_and_third_report(spark, folder):
    rows = spark.read.parquet(folder)
    refused = R.rate_limited(rows.filter("user_id = 1"), "user_id", "ts", 60, 1)
    assert refused.filter("refused").count() >= 2
    assert [r["reports"] for r in R.nth_report(rows.filter("event_type = 'error'"), "user_id", "ts", "event_id", 3).collect()] == [4]


def test_changes_and_guards(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, digest string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id int, digest string")
    assert {r["id"]: r["change"] for r in R.changed(old, new, ["id"], "digest").collect()} == {1: "same", 2: "changed", 3: "added"}
    assert R.vanished(new, old, ["id"]).count() == 1 and R.vanished(new, old.limit(0), ["id"]).count() == 0 and R.vanished(new, old, ["id"], complete=False).count() == 0
    assert {(r["id"], r["digest"]) for r in R.upserted(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    first = spark.createDataFrame([(1, 10, "x")], "k int, t int, v string").withColumn("ts", F.timestamp_seconds("t"))
    then = spark.createDataFrame([(1, 5, "y"), (1, 20, "z"), (1, 30, "z")], "k int, t int, v string").withColumn("ts", F.timestamp_seconds("t"))
    row = R.first_follow_up(first, then, ["k"], "ts", "15 seconds").select(F.unix_timestamp("at").alias("at")).first()
    assert row["at"] == 20
