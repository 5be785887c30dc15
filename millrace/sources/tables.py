"""The tables a query reads, and the entities derived from them.

The fixtures hold documents and events rather than crawled pages and query logs, so a
page's host is its document's ``source``, the tier follows from the number in it, the safety
verdict from ``labels``, and impressions from ``events``.  The same rules are given as SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(source):
    return F.substring(source, 4, 9).try_cast("int")


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, tier, zone_a_eligible, status."""
    n = _number(F.col("host"))
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("source").alias("host"))
        .distinct()
        .withColumns(
            {
                "tier": F.concat(F.lit("T"), (n % 4).cast("string")),
                "zone_a_eligible": n % 8 == 1,
                "status": F.when(n % 7 == 6, "paused").otherwise("active"),
            }
        )
    )


DOMAINS = """domains AS (
  SELECT DISTINCT source AS host, 'T' || (CAST(substr(source, 4) AS INT) % 4) AS tier,
         CAST(substr(source, 4) AS INT) % 8 = 1 AS zone_a_eligible,
         CASE WHEN CAST(substr(source, 4) AS INT) % 7 = 6 THEN 'paused' ELSE 'active' END AS status
  FROM documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, lang, text, n_chars, title, tags, verdict, suppressed, first_seen."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    verdict = F.when(F.col("toxic") == 1, "unsafe").when(F.col("quality") == 1, "safe").when(F.col("quality").isNotNull(), "review")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("page_id"),
        F.col("source").alias("host"),
        "lang",
        "text",
        "n_chars",
        F.substring_index("text", "\n", 1).alias("title"),
        verdict.alias("verdict"),
        (F.col("doc_id") % 97 == 0).alias("suppressed"),
        (F.lit("2024-01-01").cast("date") + (F.col("doc_id") % 400).cast("int")).alias("first_seen"),
    )


PAGES = (
    DOMAINS
    + """, pages_v AS (
  SELECT d.doc_id AS page_id, d.source AS host, d.lang, d.text, d.n_chars, split_part(d.text, chr(10), 1) AS title,
         CASE WHEN l.toxic = 1 THEN 'unsafe' WHEN l.quality = 1 THEN 'safe' WHEN l.quality IS NOT NULL THEN 'review' END AS verdict,
         d.doc_id % 97 = 0 AS suppressed, DATE '2024-01-01' + CAST(d.doc_id % 400 AS INT) AS first_seen
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
)


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per view or click: event_id, query, page_id, zone, position, clicked, user_id (null: anonymous), latency, ts."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click"))
    return e.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("query"),
        (F.col("event_id") % 5).alias("page_id"),
        F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("zone"),
        (F.col("event_id") % 7 + 1).cast("int").alias("position"),
        (F.col("event_type") == "click").alias("clicked"),
        F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user_id"),
        F.col("value").alias("latency"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


IMPRESSIONS = """impressions AS (
  SELECT event_id, json_extract_string(props, '$.k') AS query, event_id % 5 AS page_id,
         CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS zone, CAST(event_id % 7 + 1 AS INT) AS position,
         event_type = 'click' AS clicked, CASE WHEN user_id % 3 <> 0 THEN user_id END AS user_id, value AS latency, ts
  FROM events WHERE event_type IN ('view', 'click'))"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user turn: query_id, query (the whole turn), zone_a, zone_b (result counts), session."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.col("text").alias("query"),
        (F.col("conv_id") % 3).cast("int").alias("zone_a"),
        (F.col("conv_id") % 5).cast("int").alias("zone_b"),
        F.col("conv_id").alias("session"),
    )


QUERY_LOG = """query_log AS (
  SELECT conv_id * 1000 + turn AS query_id, text AS query,
         CAST(conv_id % 3 AS INT) AS zone_a, CAST(conv_id % 5 AS INT) AS zone_b, conv_id AS session
  FROM conversations WHERE role = 'user')"""
