"""Written intermediates in the shared folder, and ranks over a whole table without gathering it in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local one only where all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(rows: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``rows`` plus running totals within ``keys`` up to and with each row in ``order`` (which must tell rows apart).

    ``totals``: name -> column that is added up.  Rows are range-sorted once; every range adds up its own rows, and the sums of the
    ranges before it, one row a range and key, are added.  No key is ever in one task alone.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.withColumns({f"__{n}": c for n, c in totals.items()}).repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "__part").agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in totals))
    starts = sums.select(*keys, "__part", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}_before") for n in totals))
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumns({n: F.sum(f"__{n}").over(inside) for n in totals}).join(starts, [*keys, "__part"])
    return met.withColumns({n: F.col(n) + F.col(f"__{n}_before") for n in totals}).drop("__part", *(f"__{n}" for n in totals), *(f"__{n}_before" for n in totals))
