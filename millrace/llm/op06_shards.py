"""Sharding: rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the largest ``-weight / ln(u)``, where ``u`` in (0, 1)
comes from the 64-bit xxHash of shard and key.  Adding a shard adds one candidate to each
record's contest, so records move only into the new shard; the key and the shards alone decide.

Slots (places in a shard, gapless from 0) come from a range sort of (shard, key): every
range partition numbers its own rows, and the counts of the ranges before it are added.
No shard is ever gathered in one task.

Edge cases: a null key is a key of its own (all such rows share a shard); repeated keys share a
shard and get consecutive slots in the order of size and checksum, so reruns agree up to equal rows; a null or empty text has
size 16 and the checksum of no bytes; a very long one is only measured.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common

SHARDS = 40
OVERHEAD_BYTES = 16


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard that wins ``key`` among ``len(weights)`` shards of these weights."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one a shard")
    # ln(u) / weight has the order of -weight / ln(u); with equal weights, so has u itself.
    draws = [(F.shiftrightunsigned(F.xxhash64(F.lit(s), key), 11).cast("double") + 0.5) / float(2**53) for s in range(len(weights))]
    scores = draws if len(set(weights)) == 1 else [F.log(u) / float(w) for u, w in zip(draws, weights)]
    contest = F.array(*scores)
    return (F.array_position(contest, F.array_max(contest)) - 1).cast("int")


def with_slots(rows: DataFrame, shard: str, key: str, *ties: str) -> DataFrame:
    """``rows`` plus ``slot``: the place in the shard by ``key``, then ``ties``, gapless from 0."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in (key, *ties)]
    sorted_rows = common.written(rows.repartitionByRange(parts, F.col(shard), *order).withColumn("__part", F.spark_partition_id()), "slots")
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition and shard: a few rows more than there are partitions.
    starts = (
        sorted_rows.groupBy(shard, "__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(shard, "__part").orderBy(*order)
    return (
        sorted_rows.withColumn("__at", F.row_number().over(inside) - 1)
        .join(starts, [shard, "__part"])
        .withColumn("slot", (F.col("__start") + F.col("__at")).cast("bigint"))
        .drop("__start", "__at", "__part")
    )


def sharded(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and, with ``grown`` weights, grown_shard."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(body) + OVERHEAD_BYTES).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        (shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return with_slots(rows, "shard", "doc_id", "size", "text_crc32").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(common.documents(spark, sf_dir), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


QUERIES = {"op6_rendezvous_shards": op6_rendezvous_shards}
ORACLES: dict[str, str] = {}
