"""Click signals, gap reports, retention, rate limits and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import retention as keep
from millrace.operators import signals as G
from millrace.plans.registry import register
from millrace.sources import tables as S

_BIAS = "bias AS (SELECT * FROM (VALUES " + ", ".join(f"('{z}', {k}, CAST({p} AS DOUBLE))" for z, v in G.EXAMINED.items() for k, p in enumerate(v, 1)) + ") b(zone, position, examined))"
_ROLLUP = f"""{S.IMPRESSIONS}, {_BIAS}, rollup AS (
  SELECT query, page_id, count(*) AS n, CAST(sum(CAST(clicked AS INT)) AS BIGINT) AS clicks, round(sum(CAST(clicked AS INT)) / count(*), 6) AS raw_ctr,
         round(sum(CAST(clicked AS INT) / examined) / sum(1 / examined), 6) AS corrected_ctr, round(least(count(*) / 50.0, 1.0), 6)::DOUBLE AS confidence
  FROM impressions JOIN bias USING (zone, position) GROUP BY query, page_id HAVING count(*) >= 5)"""


def rollup(spark: SparkSession, d: str) -> DataFrame:
    return G.ctr_rollup(S.impressions(spark, d), G.position_bias(spark))


@register("ctr_rollup", f"WITH {_ROLLUP} SELECT * FROM rollup")
def ctr_rollup(spark, d):
    return rollup(spark, d)


@register("ctr_dropped", f"WITH {S.IMPRESSIONS}, {_BIAS} SELECT zone, position, count(*) AS n FROM impressions ANTI JOIN bias USING (zone, position) GROUP BY 1, 2")
def ctr_dropped(spark, d):
    return G.dropped_positions(S.impressions(spark, d), G.position_bias(spark))


@register("ctr_movement", f"""WITH {_ROLLUP}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY raw_ctr DESC, page_id) AS a,
  row_number() OVER (PARTITION BY query ORDER BY corrected_ctr DESC, page_id) AS b FROM rollup)
  SELECT query, page_id, CAST(a AS INT) AS raw_rank, CAST(b AS INT) AS corrected_rank, CAST(a - b AS INT) AS moved FROM r WHERE a <> b""")
def ctr_movement(spark, d):
    return G.ctr_movement(rollup(spark, d))


@register("strongest_pair", f"""WITH {_ROLLUP} SELECT page_id, query, n, corrected_ctr FROM rollup QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, query DESC) = 1""")
def strongest_pair(spark, d):
    return G.strongest_pair(rollup(spark, d))


@register("zone_ctr", f"""WITH {S.IMPRESSIONS} SELECT zone, count(*) AS impressions, count(*) FILTER (clicked) AS clicks,
  round(count(*) FILTER (clicked) / count(*), 6) AS ctr, count(*) >= 500 AND count(*) FILTER (clicked) >= 20 AS judged FROM impressions GROUP BY zone""")
def zone_ctr(spark, d):
    return G.zone_ctr(S.impressions(spark, d))


@register("ctr_by_position", f"""WITH {S.IMPRESSIONS} SELECT zone, position, count(*) AS n, round(avg(CAST(clicked AS INT)), 6) AS ctr FROM impressions WHERE position <= 10 GROUP BY ALL""")
def ctr_by_position(spark, d):
    return S.impressions(spark, d).filter("position <= 10").groupBy("zone", "position").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("clicked").cast("int")), 6).alias("ctr"))


@register("burst_filter", f"""WITH {S.IMPRESSIONS}, b AS (SELECT query, date_trunc('hour', ts) AS hour FROM impressions WHERE user_id IS NULL GROUP BY ALL HAVING count(*) >= 2)
  SELECT event_id FROM impressions i WHERE user_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM b WHERE b.query = i.query AND b.hour = date_trunc('hour', i.ts))""")
def burst_filter(spark, d):
    return G.without_bursts(S.impressions(spark, d), 2).select("event_id")


@register("zero_result_gaps", f"""WITH {S.QUERY_LOG}, g AS (SELECT lower(string_split(query, ' ')[1]) AS query, session, zone_a, zone_b FROM query_log)
  SELECT query, count(*) AS asked, count(DISTINCT session) AS sessions FROM g WHERE zone_a = 0 AND zone_b = 0 GROUP BY 1 HAVING count(*) >= 1""")
def zero_result_gaps(spark, d):
    return G.demand(_first_words(spark, d), (F.col("zone_a") == 0) & (F.col("zone_b") == 0), 1)


def _first_words(spark, d):
    return S.query_log(spark, d).withColumn("query", F.lower(F.split("query", " ")[0]))


@register("zone_a_empty", f"""WITH {S.QUERY_LOG}, g AS (SELECT lower(string_split(query, ' ')[1]) AS query, session, zone_a, zone_b FROM query_log)
  SELECT query, count(*) AS asked, count(DISTINCT session) AS sessions FROM g WHERE zone_a = 0 AND zone_b > 0 GROUP BY 1 HAVING count(*) >= 2""")
def zone_a_empty(spark, d):
    return G.demand(_first_words(spark, d), (F.col("zone_a") == 0) & (F.col("zone_b") > 0), 2)


@register("low_ctr", f"""WITH {S.IMPRESSIONS} SELECT query, count(*) AS n, round(count(*) FILTER (clicked) / count(*), 6) AS ctr FROM impressions
  WHERE zone = 'A' GROUP BY query HAVING count(*) >= 5 AND count(*) FILTER (clicked) / count(*) < 0.4""")
def low_ctr(spark, d):
    g = S.impressions(spark, d).filter("zone = 'A'").groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count_if("clicked").alias("c"))
    return g.filter((F.col("n") >= 5) & (F.col("c") / F.col("n") < 0.4)).select("query", "n", F.round(F.col("c") / F.col("n"), 6).alias("ctr"))


@register("gap_totals", f"""WITH {S.QUERY_LOG} SELECT count(*) AS searches, count(DISTINCT session) AS sessions, count(*) FILTER (zone_a + zone_b = 0) AS empty,
  count(DISTINCT query) FILTER (zone_a = 0) AS distinct_without_a, min(query_id) AS first_id, max(query_id) AS last_id FROM query_log""")
def gap_totals(spark, d):
    q = S.query_log(spark, d)
    return q.agg(
        F.count(F.lit(1)).alias("searches"),
        F.countDistinct("session").alias("sessions"),
        F.count_if(F.col("zone_a") + F.col("zone_b") == 0).alias("empty"),
        F.countDistinct(F.when(F.col("zone_a") == 0, F.col("query"))).alias("distinct_without_a"),
        F.min("query_id").alias("first_id"),
        F.max("query_id").alias("last_id"),
    )


@register("all_searches", f"""WITH {S.IMPRESSIONS} SELECT query, count(*) AS n, max(ts) AS last_ts, count(*) FILTER (zone = 'A') AS in_a, round(avg(latency), 6) AS mean_latency,
  min(latency) AS least, max(latency) AS most FROM impressions GROUP BY query""")
def all_searches(spark, d):
    return S.impressions(spark, d).groupBy("query").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("ts").cast("timestamp_ntz")).alias("last_ts"),
        F.count_if(F.col("zone") == "A").alias("in_a"),
        F.round(F.avg("latency"), 6).alias("mean_latency"),
        F.min("latency").alias("least"),
        F.max("latency").alias("most"),
    )


@register("latency_p95", """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def latency_p95(spark, d):
    return G.quantiles(S.table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@register("latency_by_cache", """SELECT event_type, event_id % 2 = 0 AS cached, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1, 2""")
def latency_by_cache(spark, d):
    e = S.table(spark, d, "events").withColumn("cached", F.col("event_id") % 2 == 0)
    return G.quantiles(e, ["event_type", "cached"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@register("ratios", f"""WITH {S.QUERY_LOG} SELECT round(avg(CASE WHEN zone_a = 0 THEN 1.0 ELSE 0 END), 6) AS empty_a, round(avg(CASE WHEN zone_b = 0 THEN 1.0 ELSE 0 END), 6) AS empty_b FROM query_log""")
def ratios(spark, d):
    share = lambda c: F.round(F.avg(F.when(F.col(c) == 0, 1.0).otherwise(0.0)), 6)
    return S.query_log(spark, d).agg(share("zone_a").alias("empty_a"), share("zone_b").alias("empty_b"))


@register("tier_object", f"""WITH {S.PAGES}, c AS (SELECT tier, count(*) AS n FROM pages_v JOIN domains USING (host) GROUP BY tier)
  SELECT '{{' || string_agg('"' || tier || '":' || n, ',' ORDER BY tier) || '}}' AS tiers FROM c""")
def tier_object(spark, d):
    c = S.pages(spark, d).join(S.domains(spark, d), "host").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tier", "n"))))).alias("tiers"))


@register("nested_terms", """SELECT lang, array_to_string(list(source ORDER BY source) FILTER (n >= 2), ',') AS sources FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang""")
def nested_terms(spark, d):
    c = S.table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("n") >= 2, F.col("source")))), ",").alias("sources"))


@register("top_queries", f"""WITH {S.IMPRESSIONS} SELECT query, count(*) AS n FROM impressions GROUP BY 1 ORDER BY n DESC, query LIMIT 30""")
def top_queries(spark, d):
    return S.impressions(spark, d).groupBy("query").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "query").limit(30)


@register("engagement", """SELECT doc_id AS page_id, round(100 * (0.30 * greatest(0, least(1, n_chars * 20 / 180000.0))
  + 0.25 * CASE WHEN doc_id % 3 = 0 THEN 0 ELSE greatest(0, least(1, (doc_id % 120) / 100.0)) END + 0.20 * greatest(0, least(1, (doc_id % 90) / 100.0))
  + 0.15 * CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 - greatest(0, least(1, (doc_id % 100) / 100.0)) END
  + 0.10 * greatest(0, least(1, log10(1 + doc_id % 2000) / log10(1001.0)))), 2) AS score FROM documents""")
def engagement(spark, d):
    i = F.col("doc_id")
    score = G.engagement_score(
        F.col("n_chars") * 20, F.when(i % 3 != 0, i % 120), i % 90, F.when(i % 5 != 0, i % 100), i % 2000
    )
    return S.table(spark, d, "documents").select(i.alias("page_id"), score.alias("score"))


@register("quality", """SELECT doc_id AS page_id, round(least(100.0, greatest(0.0, 30 * least(1.0, ln(1 + n_chars // 6) / ln(1201.0)) + 10 + CASE WHEN doc_id % 2 = 0 THEN 8 ELSE 0 END + 6
  + CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 0 END + 0 + CASE WHEN doc_id % 5 = 0 THEN 5 ELSE 0 END + 20 * least(1.0, ln(1 + doc_id % 60) / ln(51.0)) + CASE WHEN doc_id % 7 <> 0 THEN 10 ELSE 0 END)), 2) AS score FROM documents""")
def quality(spark, d):
    i = F.col("doc_id")
    flags = {"title": F.lit(True), "description": i % 2 == 0, "category": F.lit(True), "date": i % 3 == 0, "tags": F.lit(False), "author": i % 5 == 0}
    score = G.quality_score(F.floor(F.col("n_chars") / 6), flags, i % 60, F.when(i % 7 == 0, 1).otherwise(0))
    return S.table(spark, d, "documents").select(i.alias("page_id"), score.alias("score"))


@register("retention_dryrun", f"""WITH {S.IMPRESSIONS} SELECT 'anonymise' AS action, count(*) AS n FROM impressions WHERE ts < TIMESTAMP '2024-01-10' AND user_id IS NOT NULL
  UNION ALL SELECT 'delete', count(*) FROM impressions WHERE ts < TIMESTAMP '2024-01-04' AND user_id IS NULL""")
def retention_dryrun(spark, d):
    return keep.dry_run(S.impressions(spark, d), "user_id", "ts", F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-04").cast("timestamp"))


@register("retention_applied", f"""WITH {S.IMPRESSIONS} SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN NULL ELSE user_id END AS user_id FROM impressions
  WHERE NOT (ts < TIMESTAMP '2024-01-04' AND user_id IS NULL)""")
def retention_applied(spark, d):
    return keep.applied(S.impressions(spark, d), "user_id", "ts", F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-04").cast("timestamp")).select("event_id", "user_id")


@register("rate_limit", """SELECT event_id, n > 2 AS refused FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events)""")
def rate_limit(spark, d):
    return keep.rate_limited(S.table(spark, d, "events"), "user_id", "ts", 7200, 2).select("event_id", "refused")


@register("abuse_suppressed", """SELECT user_id AS page_id, count(*) AS reports, min(ts) FILTER (k = 3) AS suppressed_at FROM
  (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error') GROUP BY 1 HAVING count(*) >= 3""")
def abuse_suppressed(spark, d):
    e = S.table(spark, d, "events").filter("event_type = 'error'")
    return keep.nth_report(e, "user_id", "ts", "event_id", 3).select(F.col("user_id").alias("page_id"), "reports", F.col("at").alias("suppressed_at"))


@register("sessions", """SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def sessions(spark, d):
    e = S.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("t", "30 minutes")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "started", "ended", "n")


@register("hourly_events", """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_events(spark, d):
    e = S.table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("first_click", """SELECT i.event_id, min(c.ts) AS clicked_at FROM events i LEFT JOIN events c ON c.event_type = 'click' AND c.user_id = i.user_id
  AND json_extract_string(c.props, '$.k') = json_extract_string(i.props, '$.k') AND c.ts BETWEEN i.ts AND i.ts + INTERVAL 1 DAY WHERE i.event_type = 'view' GROUP BY 1""")
def first_click(spark, d):
    e = S.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return keep.first_follow_up(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id", "k"], "ts", "1 day").select("event_id", F.col("at").alias("clicked_at"))
