"""Frontier, lookups, mutations, reports and evaluation queries, each a fold or report over the fixture tables.

How the fixtures stand in: suppliers are domains with a crawl schedule, events are queue items, log lines and administration events, orders are
runs and decisions, ``documents`` are pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import admin as A
from millrace.operators import embedding as M
from millrace.operators import evaluation as E
from millrace.operators import frontier as C
from millrace.operators import gate, lexicon
from millrace.operators import safety as X
from millrace.operators.retention import latest
from millrace.plans import search as P
from millrace.plans.graph import _HOST
from millrace.plans.registry import register
from millrace.plans.search import SERVED, TERMS, WORDS
from millrace.sources import tables as S

NOW = "2024-01-20 00:00:00"


def _at(text: str = NOW):
    return F.lit(text).cast("timestamp_ntz")


def _docs(spark, d):
    return S.table(spark, d, "documents")


def _events(spark, d):
    return S.table(spark, d, "events")


# --- frontier ------------------------------------------------------------------------------

_NORMAL = """SELECT page_id, url, CASE WHEN h = '' THEN trim(url) ELSE 'https://' || regexp_replace(lower(h), '^www\\.', '') ||
    CASE WHEN p = '' OR p = '/' THEN '/' ELSE regexp_replace(p, '/$', '') END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS normal
  FROM (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1) AS h, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '(?i)^(utm_.*|fbclid|gclid|msclkid|mc_eid|ref)$'))), '&') AS q FROM pages)"""
_LINKED = f"""n AS ({_NORMAL}), l AS (SELECT page_id, url, normal, regexp_extract({_HOST}, '[^.]+\\.[^.]+$') AS domain, page_id % 9 AS depth,
    regexp_matches(url, '(?i)[?&](sessionid|phpsessid|jsessionid|sid|replytocom|share|print|utm_|fbclid|gclid)') AS trap FROM n),
  ok AS (SELECT DISTINCT normal, domain FROM l WHERE depth <= 6 AND NOT trap AND domain <> ''),
  fresh AS (SELECT normal, domain FROM l WHERE page_id % 3 = 0 GROUP BY 1, 2 HAVING min(page_id % 48) < 24),
  queued AS (SELECT DISTINCT normal, domain FROM l WHERE page_id % 7 = 5),
  used AS (SELECT domain, count(*) AS used FROM (SELECT domain FROM l WHERE page_id % 3 = 0 UNION ALL SELECT domain FROM l WHERE page_id % 7 = 5) GROUP BY 1)"""


def _links(spark, d):
    rows = S.table(spark, d, "pages").withColumn("domain", F.regexp_extract(U.host_of(F.col("url")), "[^.]+\\.[^.]+$", 0)).filter("domain <> ''")
    return rows.select("page_id", "url", "domain", (F.col("page_id") % 9).alias("depth"), F.lit("crawl").alias("source"))


def _enqueued(spark, d):
    links = _links(spark, d)
    domains = links.select("domain").distinct().select("domain", F.lit(6).alias("max_depth"), F.lit(24).alias("interval_hours"), F.lit(60).alias("max_pages"))
    pages = links.filter("page_id % 3 = 0").select("url", "domain", (_at() - F.make_interval(hours=(F.col("page_id") % 48).cast("int"))).alias("fetched_at"))
    queued = links.filter("page_id % 7 = 5").select(U.normalized_url(F.col("url")).alias("url"), "domain")
    return C.enqueued(links, domains, pages, queued, _at())


@register("frontier_enqueue", f"""WITH {_LINKED}, w AS (SELECT * FROM ok ANTI JOIN fresh USING (normal, domain) ANTI JOIN queued USING (normal, domain))
  SELECT normal AS url, domain, row_number() OVER (PARTITION BY domain ORDER BY normal) AS place FROM w JOIN (SELECT DISTINCT domain FROM l) USING (domain) LEFT JOIN used USING (domain)
  QUALIFY place <= 60 - coalesce(used, 0)""")
def frontier_enqueue(spark, d):
    """Links that are admitted, neither fresh nor queued, within each domain's page budget."""
    return _enqueued(spark, d)[0]


@register("frontier_refused", f"WITH {_LINKED} SELECT url, domain, CASE WHEN depth > 6 THEN 'too deep' ELSE 'trap parameter' END AS reason FROM l WHERE domain <> '' AND (depth > 6 OR trap)")
def frontier_refused(spark, d):
    return _enqueued(spark, d)[1]


_SITES = """sites AS (SELECT s_suppkey AS id, s_name AS host, 'T' || (s_suppkey % 4) AS tier, CASE WHEN s_suppkey % 7 = 6 THEN 'paused' ELSE 'active' END AS status,
  CASE s_suppkey % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'crawl' ELSE 'hybrid' END AS mode, CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 60 AS INT)) END AS next_due,
  s_suppkey % 8 = 1 AND s_suppkey % 4 = 1 AS zone_a_eligible, 'tok' || s_suppkey AS token FROM supplier)"""


def _sites(spark, d):
    k = F.col("s_suppkey")
    return S.table(spark, d, "supplier").select(
        k.alias("id"),
        F.col("s_name").alias("host"),
        F.concat(F.lit("T"), (k % 4).cast("string")).alias("tier"),
        F.when(k % 7 == 6, "paused").otherwise("active").alias("status"),
        F.when(k % 3 == 0, "source").when(k % 3 == 1, "crawl").otherwise("hybrid").alias("mode"),
        F.when(k % 5 != 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=(k % 60).cast("int"))).alias("next_due"),
        ((k % 8 == 1) & (k % 4 == 1)).alias("zone_a_eligible"),
        F.concat(F.lit("tok"), k.cast("string")).alias("token"),
    )


@register("due_domains", f"""WITH {_SITES} SELECT host, tier, row_number() OVER (PARTITION BY tier ORDER BY next_due NULLS FIRST, host) AS place FROM sites
  WHERE status = 'active' AND mode IN ('crawl', 'hybrid') AND (next_due IS NULL OR next_due <= TIMESTAMP '{NOW}')""")
def due_domains(spark, d):
    return C.due(_sites(spark, d), _at()).select("host", "tier", "place")


_QUEUE = """queue AS (SELECT event_id AS id, ts AS scheduled_for, event_id % 8 AS attempts, CASE WHEN event_type = 'click' THEN 'w' || user_id END AS claimed_by,
  CASE WHEN event_type = 'click' THEN ts END AS claimed_at, CAST(NULL AS VARCHAR) AS last_error FROM events)"""


def _queue(spark, d):
    click = F.col("event_type") == "click"
    return _events(spark, d).select(
        F.col("event_id").alias("id"), F.col("ts").alias("scheduled_for"), (F.col("event_id") % 8).alias("attempts"),
        F.when(click, F.concat(F.lit("w"), F.col("user_id").cast("string"))).alias("claimed_by"), F.when(click, F.col("ts")).alias("claimed_at"), F.lit(None).cast("string").alias("last_error"),
    )


@register("queue_open", f"WITH {_QUEUE} SELECT id FROM queue WHERE claimed_by IS NULL AND scheduled_for <= TIMESTAMP '{NOW}' AND attempts < 5")
def queue_open(spark, d):
    """Items that may be claimed: the partial indexes of a queue as a filter."""
    return C.claimable(_queue(spark, d), _at()).select("id")


@register("queue_release", f"""WITH {_QUEUE}, r AS (SELECT *, id % 11 = 0 AS put, coalesce(claimed_at < TIMESTAMP '{NOW}' - INTERVAL 60 MINUTES, false) AS stale FROM queue)
  SELECT id, CASE WHEN put THEN TIMESTAMP '{NOW}' + INTERVAL 90 SECONDS ELSE scheduled_for END AS scheduled_for, CASE WHEN put THEN 'busy' END AS last_error,
    CASE WHEN NOT (put OR stale) THEN claimed_by END AS claimed_by FROM r""")
def queue_release(spark, d):
    out = C.released(_queue(spark, d), F.col("id") % 11 == 0, F.make_interval(secs=F.lit(90)), F.lit("busy"), _at())
    return out.select("id", "scheduled_for", "last_error", "claimed_by")


@register("run_log", """WITH r AS (SELECT o_custkey AS key, o_orderdate AS t, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS changed, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS failed FROM orders),
  n AS (SELECT *, max(CASE WHEN NOT (failed > 0 AND changed = 0) THEN k END) OVER (PARTITION BY key) AS good, max(CASE WHEN changed > 0 THEN k END) OVER (PARTITION BY key) AS new
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS k FROM r))
  SELECT key, count(*) AS runs, count(*) FILTER (good IS NULL OR k > good) AS failed_in_row, count(*) FILTER (new IS NULL OR k > new) AS unchanged_in_row, count(*) FILTER (good IS NULL OR k > good) >= 3 AS paused FROM n GROUP BY key""")
def run_log(spark, d):
    """How each key's runs end, and whether three failures in a row pause it."""
    runs = S.table(spark, d, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("changed"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0).alias("failed"),
    )
    return C.finished(runs, ["at", "id"])


#: Nations list their customers' pages through two levels of sitemap indexes, with a circle back to the region.
_MAPS = """maps AS (SELECT 'r' || n_regionkey AS sitemap, 'n' || n_nationkey AS url, 'index' AS kind FROM nation UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'index' FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'page' FROM customer UNION ALL SELECT 'r' || r_regionkey, 'about' || r_regionkey, 'page' FROM region)"""


@register("sitemap_seeds", f"""WITH {_MAPS} SELECT url, 1 AS depth FROM maps WHERE kind = 'page' AND sitemap IN ('r1', 'r2')
  UNION ALL SELECT url, 2 FROM maps WHERE kind = 'page' AND sitemap IN (SELECT url FROM maps WHERE sitemap IN ('r1', 'r2') AND kind = 'index')""")
def sitemap_seeds(spark, d):
    text = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    n, kind = S.table(spark, d, "nation"), lambda k: F.lit(k).alias("kind")
    rows = n.select(text("r", "n_regionkey").alias("sitemap"), text("n", "n_nationkey").alias("url"), kind("index"))
    rows = rows.unionByName(n.select(text("n", "n_nationkey").alias("sitemap"), text("r", "n_regionkey").alias("url"), kind("index")))
    rows = rows.unionByName(S.table(spark, d, "customer").select(text("n", "c_nationkey").alias("sitemap"), text("c", "c_custkey").alias("url"), kind("page")))
    rows = rows.unionByName(S.table(spark, d, "region").select(text("r", "r_regionkey").alias("sitemap"), text("about", "r_regionkey").alias("url"), kind("page")))
    return C.seeded(spark.createDataFrame([("r1",), ("r2",)], "url string"), rows)


_FETCHES = """fetches AS (SELECT event_id AS id, user_id AS url, ts AS t, CASE WHEN event_id % 13 = 0 THEN 'robots' WHEN event_id % 17 = 0 THEN 'error' WHEN s IN (404, 410) THEN 'gone' WHEN s = 429 OR s >= 500 THEN 'retry'
    WHEN s = 304 THEN 'unchanged' WHEN s >= 400 THEN 'error' WHEN event_type = 'view' THEN 'refused type' WHEN value > 40 THEN 'too large' ELSE 'ok' END AS outcome
  FROM (SELECT *, [200, 200, 200, 404, 429, 503, 304, 403][event_id % 8 + 1] AS s FROM events))"""


def _fetches(spark, d):
    i = F.col("event_id")
    status = F.get(F.array(*map(F.lit, (200, 200, 200, 404, 429, 503, 304, 403))), (i % 8).cast("int"))
    kind = F.when(F.col("event_type") == "view", "image/png").otherwise("text/html; charset=utf-8")
    out = C.outcome(status, i % 13 != 0, F.when(i % 17 == 0, "reset"), kind, F.col("value"), most_bytes=40)
    return _events(spark, d).select(i.alias("id"), F.col("user_id").alias("url"), F.col("ts").alias("at"), out.alias("outcome"))


@register("fetch_outcomes", f"WITH {_FETCHES} SELECT outcome, count(*) AS n FROM fetches GROUP BY 1")
def fetch_outcomes(spark, d):
    return _fetches(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register("fetch_failures", f"WITH {_FETCHES} SELECT url, count(*) AS attempts, count(*) FILTER (outcome = 'error') AS errors, arg_max(outcome, (t, id)) AS last_outcome FROM fetches GROUP BY 1")
def fetch_failures(spark, d):
    return C.failures(_fetches(spark, d))


@register("retry_wait", """SELECT event_id AS id, least(600000.0, CASE WHEN event_id % 3 = 0 THEN (event_id % 900) * 1000.0 ELSE 1000 * pow(2, event_id % 12) * (0.5 + (event_id % 10) / 10.0 / 2) END)::DOUBLE AS wait_ms FROM events""")
def retry_wait(spark, d):
    i = F.col("event_id")
    return _events(spark, d).select(i.alias("id"), C.wait_ms((i % 12).cast("double"), i % 10 / 10.0, F.when(i % 3 == 0, i % 900)).alias("wait_ms"))


@register("page_failures_log", """SELECT user_id AS url, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM events WHERE event_type = 'error' QUALIFY place <= 20""")
def page_failures_log(spark, d):
    """The last twenty failures of every URL."""
    rows = _events(spark, d).filter("event_type = 'error'").select(F.col("user_id").alias("url"), F.col("event_id").alias("id"), "ts")
    return C.latest_of(rows, "url", [F.col("ts").desc(), F.col("id").desc()], 20).select("url", "id", "place")


# --- lookups -------------------------------------------------------------------------------


@register("explain_page", f"""WITH {SERVED} SELECT p.page_id, p.host, CAST(len(string_split(p.text, chr(10))) AS INT) AS n_blocks, s.page_id IS NOT NULL AS served, CASE WHEN p.suppressed THEN 'suppressed' WHEN d.status <> 'active' THEN 'domain is not active'
  WHEN d.tier = 'T0' THEN 'domain is in quarantine' WHEN d.tier = 'T2' AND coalesce(p.verdict, '') = 'unsafe' THEN 'judged unsafe' WHEN d.tier = 'T3' AND coalesce(p.verdict, '') <> 'safe' THEN 'not judged safe' END AS reason
  FROM pages_v p LEFT JOIN domains d USING (host) LEFT JOIN served s ON s.page_id = p.page_id""")
def explain_page(spark, d):
    pages, domains = S.pages(spark, d), S.domains(spark, d)
    told = gate.why_not(pages, domains).select("page_id", "host", F.size(F.split("text", "\n")).alias("n_blocks"), "reason")
    served = gate.servable(pages, domains).select("page_id", F.lit(True).alias("__served"))
    return told.join(served, "page_id", "left").select("page_id", "host", "n_blocks", F.coalesce("__served", F.lit(False)).alias("served"), "reason")


@register("health", """SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(DISTINCT source) FROM documents) AS domains, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors,
  (SELECT count(*) FROM conversations WHERE role = 'user') AS queries, (SELECT count(*) FROM labels WHERE toxic = 1) AS unsafe, (SELECT max(ts) FROM events) AS last_event""")
def health(spark, d):
    """One row of counts; each is an aggregate of its own, joined as single rows."""
    one = lambda t, *columns: S.table(spark, d, t).agg(*columns)
    n = F.count(F.lit(1))
    parts = [
        one("documents", n.alias("pages"), F.countDistinct("source").alias("domains")),
        one("embeddings", n.alias("vectors")),
        one("events", F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("last_event")),
        one("conversations", F.count_if(F.col("role") == "user").alias("queries")),
        one("labels", F.count_if(F.col("toxic") == 1).alias("unsafe")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


@register("dashboard", f"""WITH {S.PAGES}, p AS (SELECT * FROM pages_v JOIN domains USING (host)) SELECT count(*) AS pages, count(*) FILTER (tier = 'T1') AS t1, count(*) FILTER (tier = 'T2') AS t2, count(*) FILTER (tier = 'T3') AS t3, count(*) FILTER (tier = 'T0') AS t0,
  count(*) FILTER (suppressed) AS suppressed, count(*) FILTER (verdict = 'unsafe') AS unsafe, count(*) FILTER (verdict = 'review') AS review, count(*) FILTER (verdict IS NULL) AS unjudged, count(DISTINCT host) AS hosts,
  count(DISTINCT host) FILTER (status = 'active') AS active_hosts, CAST(sum(n_chars) AS BIGINT) AS chars, max(first_seen) AS newest FROM p""")
def dashboard(spark, d):
    p = S.pages(spark, d).join(S.domains(spark, d), "host")
    tier = lambda t: F.count_if(F.col("tier") == t).alias(t.lower())
    return p.agg(
        F.count(F.lit(1)).alias("pages"), tier("T1"), tier("T2"), tier("T3"), tier("T0"), F.count_if("suppressed").alias("suppressed"),
        F.count_if(F.col("verdict") == "unsafe").alias("unsafe"), F.count_if(F.col("verdict") == "review").alias("review"), F.count_if(F.col("verdict").isNull()).alias("unjudged"),
        F.countDistinct("host").alias("hosts"), F.countDistinct(F.when(F.col("status") == "active", F.col("host"))).alias("active_hosts"), F.sum("n_chars").alias("chars"), F.max("first_seen").alias("newest"),
    )


@register("domain_list", f"""WITH {S.PAGES} SELECT d.host, tier, status, count(page_id) FILTER (NOT suppressed) AS indexed FROM domains d LEFT JOIN pages_v USING (host) WHERE status = 'active' AND tier IN ('T1', 'T2') GROUP BY 1, 2, 3""")
def domain_list(spark, d):
    rows = S.domains(spark, d).filter("status = 'active' AND tier IN ('T1', 'T2')")
    counts = S.pages(spark, d).filter(~F.col("suppressed")).groupBy("host").agg(F.count(F.lit(1)).alias("indexed"))
    return rows.join(counts, "host", "left").select("host", "tier", "status", F.coalesce("indexed", F.lit(0)).cast("bigint").alias("indexed"))


@register("safety_queue", f"""WITH {S.PAGES} SELECT page_id, date_diff('hour', CAST(first_seen AS TIMESTAMP), TIMESTAMP '2025-03-01') AS age_hours, substr(text, 1, 4000) AS excerpt FROM pages_v WHERE verdict = 'review' ORDER BY first_seen, page_id LIMIT 100""")
def safety_queue(spark, d):
    """The hundred oldest pages that wait for a decision, with an excerpt."""
    rows = S.pages(spark, d).filter("verdict = 'review'").orderBy("first_seen", "page_id").limit(100)
    age = (F.unix_seconds(F.lit("2025-03-01").cast("timestamp")) - F.unix_seconds(F.col("first_seen").cast("timestamp"))) / 3600
    return rows.select("page_id", age.cast("bigint").alias("age_hours"), F.substring("text", 1, 4000).alias("excerpt"))


@register("candidate_queue", f"""WITH {S.PAGES} SELECT host, tier, count(*) AS pages, count(*) FILTER (verdict IS NOT NULL) AS probed, count(*) FILTER (verdict = 'safe') AS passed, date_diff('day', min(first_seen), DATE '2025-06-01') AS age_days
  FROM pages_v JOIN domains USING (host) WHERE tier IN ('T0', 'T3') GROUP BY 1, 2""")
def candidate_queue(spark, d):
    rows = S.pages(spark, d).join(S.domains(spark, d), "host").filter("tier IN ('T0', 'T3')")
    return rows.groupBy("host", "tier").agg(
        F.count(F.lit(1)).alias("pages"), F.count("verdict").alias("probed"), F.count_if(F.col("verdict") == "safe").alias("passed"),
        F.datediff(F.lit("2025-06-01").cast("date"), F.min("first_seen")).cast("bigint").alias("age_days"),
    )


@register("candidate_counts", """SELECT o_orderpriority AS tier, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
def candidate_counts(spark, d):
    return S.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("audit_recent", "SELECT event_id AS id, user_id AS bet_id, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_recent(spark, d):
    return _events(spark, d).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50).select(F.col("event_id").alias("id"), F.col("user_id").alias("bet_id"), F.col("event_type").alias("action"))


@register("lexicon_preview", f"""WITH {TERMS}, q AS (SELECT * FROM (VALUES (1, 'The BLEES of eresan'), (2, 'onesen the blees?')) q(query_id, raw)), n AS (SELECT query_id, {P.NORM.format('raw')} AS normalized, list_distinct({WORDS.format('raw')}) AS w FROM q)
  SELECT n.query_id, any_value(normalized) AS normalized, coalesce(array_to_string(list_sort(list(DISTINCT t2.term) FILTER (t2.term <> t1.term AND t2.lang = 'en' AND NOT list_contains(w, t2.term))), ' '), '') AS expansions
  FROM n LEFT JOIN terms t1 ON list_contains(w, t1.term) LEFT JOIN terms t2 ON t1.concept = t2.concept GROUP BY 1""")
def lexicon_preview(spark, d):
    """Normal form and expansions of queries, without a search."""
    q = spark.createDataFrame([(1, "The BLEES of eresan"), (2, "onesen the blees?")], "query_id int, raw string")
    q = q.withColumn("normalized", T.normalized(F.col("raw"))).withColumn("tokens", F.array_distinct(T.words(F.col("normalized")))).withColumn("lang", F.lit("en"))
    found = lexicon.expand(q, P.lexicon_terms(spark, d)).select("query_id", F.explode("terms").alias("t")).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("t")), " ").alias("expansions"))
    return q.join(found, "query_id", "left").select("query_id", "normalized", F.coalesce("expansions", F.lit("")).alias("expansions"))


@register("busiest_host", f"""WITH {S.PAGES} SELECT host, count(*) AS n FROM pages_v JOIN domains USING (host) WHERE zone_a_eligible AND status = 'active' GROUP BY 1 ORDER BY n DESC, host LIMIT 1""")
def busiest_host(spark, d):
    rows = S.pages(spark, d).join(S.domains(spark, d), "host").filter("zone_a_eligible AND status = 'active'")
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "host").limit(1)


@register("cache_keys", f"""WITH {S.QUERY_LOG} SELECT query_id, sha256('v=7&' || CASE WHEN session % 2 = 0 THEN 'lang=fr&' ELSE '' END || 'q=' || {P.NORM.format('query')}) AS key FROM query_log""")
def cache_keys(spark, d):
    lang = F.when(F.col("session") % 2 == 0, "fr")
    return S.query_log(spark, d).select("query_id", A.cache_key(F.lit(7), {"q": T.normalized(F.col("query")), "lang": lang}).alias("key"))


@register("cache_live", f"""SELECT user_id AS key, event_id AS id FROM events WHERE event_id % 3 = 1 AND ts > TIMESTAMP '{NOW}' - INTERVAL 6000 MINUTES QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def cache_live(spark, d):
    rows = _events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("event_id") % 3).alias("version"))
    return A.live_entries(rows, _at(), F.lit(6000), F.lit(1)).select("key", "id")


# --- mutations -----------------------------------------------------------------------------

_PINS = "pins AS (SELECT event_id, user_id AS bet_id, ts AS t, CASE event_type WHEN 'signup' THEN 'delete' WHEN 'click' THEN 'deactivate' ELSE 'update' END AS action, value AS position FROM events)"


def _pins(spark, d):
    action = F.when(F.col("event_type") == "signup", "delete").when(F.col("event_type") == "click", "deactivate").otherwise("update")
    return _events(spark, d).select("event_id", F.col("user_id").alias("bet_id"), F.col("ts").alias("at"), action.alias("action"), F.col("value").alias("position"))


@register("pins_state", f"WITH {_PINS} SELECT bet_id, action <> 'deactivate' AS active, position FROM pins QUALIFY row_number() OVER (PARTITION BY bet_id ORDER BY t DESC, event_id DESC) = 1 AND action <> 'delete'")
def pins_state(spark, d):
    """Editorial pins as the fold of what was done to them."""
    return A.folded(_pins(spark, d), ["bet_id"], ["at", "event_id"]).select("bet_id", (F.col("action") != "deactivate").alias("active"), "position")


@register("pin_errors", """SELECT event_id AS id, CASE WHEN length(event_type) < 5 AND event_id % 4 = 0 THEN 'pattern too short' WHEN event_id % 170 > 160 THEN 'blurb too long' WHEN event_id % 6 = 0 AND event_id % 5 >= 3 THEN 'window ends before it starts' END AS reason FROM events""")
def pin_errors(spark, d):
    i = F.col("event_id")
    pattern = F.when((i % 4 == 0) & (F.length("event_type") < 5), " a ").otherwise(F.col("event_type"))
    starts, ends = F.when(i % 6 == 0, F.col("ts")), F.when(i % 5 >= 3, F.col("ts") - F.make_interval(hours=F.lit(1))).otherwise(F.col("ts") + F.make_interval(hours=F.lit(1)))
    return _events(spark, d).select(i.alias("id"), A.pin_error(pattern, F.repeat(F.lit("b"), (i % 170).cast("int")), starts, ends).alias("reason"))


@register("ranking_update", """SELECT event_id AS id, k AS key, value AS new_value, lag(value) OVER (PARTITION BY k ORDER BY ts, event_id) AS old_value FROM (SELECT *, event_type AS k FROM events WHERE event_type IN ('view', 'click', 'purchase'))""")
def ranking_update(spark, d):
    """Changes of known settings with the value before; unknown keys are refused."""
    from millrace.operators.retention import audited

    known = _events(spark, d).filter(F.col("event_type").isin("view", "click", "purchase"))
    return audited(known, ["event_type"], ["ts", "event_id"], "value").select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.col("value").alias("new_value"), "old_value")


@register("ranking_refused", "SELECT event_type AS key, count(*) AS refused FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 1")
def ranking_refused(spark, d):
    return _events(spark, d).filter(~F.col("event_type").isin("view", "click", "purchase")).groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("refused"))


@register("domains_verified", f"""WITH {_SITES} SELECT host, id % 10 < 3 AS verified, id % 10 < 3 OR zone_a_eligible AS zone_a_eligible, CASE WHEN id % 10 < 3 THEN 'active' ELSE status END AS status FROM sites""")
def domains_verified(spark, d):
    """Domains after proofs: right tokens by a known method count, wrong ones and other methods do not."""
    s = _sites(spark, d)
    proofs = s.filter("id % 10 < 5").select("host", F.when(F.col("id") % 10 < 4, F.lit("dns")).otherwise(F.lit("phone")).alias("method"), F.when(F.col("id") % 10 == 3, F.lit("wrong")).otherwise(F.col("token")).alias("token"))
    return A.verified(s, proofs).select("host", "verified", "zone_a_eligible", "status")


@register("domains_edited", f"""WITH {_SITES} SELECT host, CASE WHEN id % 6 = 0 THEN 'T3' ELSE tier END AS tier, CASE WHEN id % 6 = 0 THEN tier = 'T3' AND false ELSE zone_a_eligible END AS zone_a_eligible,
  CASE WHEN id % 4 = 1 THEN 'paused' ELSE status END AS status, token FROM sites""")
def domains_edited(spark, d):
    """Edits of listed fields only; leaving the first tier ends the right to Zone A."""
    s = _sites(spark, d)
    edit = lambda cond, field, value, at: s.filter(cond).select("host", F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(at).alias("at"))
    edits = edit("id % 6 = 0", "tier", "T2", 1).unionByName(edit("id % 6 = 0", "tier", "T3", 2)).unionByName(edit("id % 4 = 1", "status", "paused", 1)).unionByName(edit("true", "token", "stolen", 3))
    return A.edited(s, edits, ["tier", "status"]).select("host", "tier", "zone_a_eligible", "status", "token")


@register("domain_purge", f"""WITH {S.PAGES} SELECT 'pages' AS name, count(*) AS n FROM pages_v JOIN domains USING (host) WHERE tier <> 'T0' UNION ALL SELECT 'domains', count(*) FROM domains WHERE tier <> 'T0'""")
def domain_purge(spark, d):
    """What is left of each table after the quarantined hosts are purged."""
    domains = S.domains(spark, d)
    left = A.purged({"pages": S.pages(spark, d), "domains": domains}, domains.filter("tier = 'T0'"), "host")
    count = lambda name: left[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return count("pages").unionByName(count("domains"))


@register("safety_decisions", """SELECT o_custkey AS page_id, CASE o_orderstatus WHEN 'F' THEN 'safe' WHEN 'O' THEN 'unsafe' ELSE 'blocked' END AS verdict FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def safety_decisions(spark, d):
    """The last decision on each page: approved, rejected, or its domain blocked."""
    last = latest(S.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return last.select(F.col("o_custkey").alias("page_id"), F.when(F.col("o_orderstatus") == "F", "safe").when(F.col("o_orderstatus") == "O", "unsafe").otherwise("blocked").alias("verdict"))


@register("rule_errors", """SELECT p_partkey AS id, CASE WHEN p_size > 45 THEN 'severity out of range' WHEN p_size >= 40 AND p_partkey % 3 = 0 AND NOT contains(p_name, ' ') THEN 'one word may not block' END AS reason FROM part""")
def rule_errors(spark, d):
    """Rules added by hand that are refused, with the reason."""
    kind = F.when(F.col("p_partkey") % 3 == 0, "keyword").otherwise("host")
    severity = F.when(F.col("p_size") > 45, 101).when(F.col("p_size") >= 40, 100).otherwise(F.col("p_size"))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), A.rule_error(F.col("p_name"), kind, severity).alias("reason"))


@register("tier_defaults", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {n}, {depth}, {'NULL' if z is None else repr(z)})" for t, n, depth, z in A.TIERS) + ") t(tier, max_pages, max_depth, zone)")
def tier_defaults(spark, d):
    return spark.createDataFrame(A.TIERS, "tier string, max_pages int, max_depth int, zone string")


@register("reindex", """SELECT doc_id AS page_id, CASE WHEN source NOT IN ('src3', 'src8') THEN md5(text) END AS digest, source IN ('src3', 'src8') AS requeued FROM documents""")
def reindex(spark, d):
    """Pages of two hosts lose their hashes and are queued again; other pages keep theirs."""
    again = F.col("source").isin("src3", "src8")
    return _docs(spark, d).select(F.col("doc_id").alias("page_id"), F.when(~again, F.md5("text")).alias("digest"), again.alias("requeued"))


@register("pages_gone", f"""WITH {_FETCHES}, last AS (SELECT url, arg_max(outcome, (t, id)) AS o FROM fetches GROUP BY 1) SELECT doc_id AS page_id, coalesce(o = 'gone', false) AS gone, CASE WHEN coalesce(o = 'gone', false) THEN 0 ELSE len(string_split(text, chr(10))) END AS blocks_left
  FROM documents LEFT JOIN last ON url = doc_id""")
def pages_gone(spark, d):
    """Pages whose last fetch said they are gone, and what is left of their blocks."""
    last = C.failures(_fetches(spark, d)).select(F.col("url").alias("doc_id"), "last_outcome")
    gone = F.coalesce(F.col("last_outcome") == "gone", F.lit(False))
    rows = _docs(spark, d).join(last, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("page_id"), gone.alias("gone"), F.when(gone, 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint").alias("blocks_left"))


@register("priority_bump", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN least(CAST(substr(o_orderpriority, 1, 1) AS INT), 2) ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) END AS priority FROM orders")
def priority_bump(spark, d):
    """A publish push raises an item to priority 2 unless it stands higher."""
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    return S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", F.least(p, F.lit(2))).otherwise(p).alias("priority"))


@register("content_requests", "SELECT conv_id, turn, trim(substr(text, 1, 500)) AS request, CAST(NULL AS BIGINT) AS user_id FROM conversations WHERE role = 'user' AND trim(text) <> ''")
def content_requests(spark, d):
    """What visitors ask for, to 500 characters, without who asked."""
    rows = S.table(spark, d, "conversations").filter("role = 'user' AND trim(text) <> ''")
    return rows.select("conv_id", "turn", F.trim(F.substring("text", 1, 500)).alias("request"), F.lit(None).cast("bigint").alias("user_id"))


@register("lexicon_upsert", f"""WITH {TERMS} SELECT term, CASE WHEN length(term) = 5 AND term < 'm' THEN 0.3 WHEN length(term) = 6 THEN 0.75 ELSE weight END::DOUBLE AS weight, concept FROM terms""")
def lexicon_upsert(spark, d):
    """Terms after an import: the last row of a term stands, rows with a weight out of range are left out."""
    from millrace.operators.retention import upserted
    from millrace.sources.articles import validated

    old = P.lexicon_terms(spark, d).select("term", F.col("weight").cast("double").alias("weight"), "concept")
    five, six = old.filter("length(term) = 5 AND term < 'm'"), old.filter(F.length("term") == 6)
    rows = five.withColumns({"weight": F.lit(0.9), "at": F.lit(1)}).unionByName(five.withColumns({"weight": F.lit(0.3), "at": F.lit(2)}))
    rows = rows.unionByName(six.withColumns({"weight": F.lit(0.75), "at": F.lit(1)})).unionByName(six.withColumns({"weight": F.lit(7.0), "at": F.lit(2)}))
    good, _ = validated(rows, {"weight": F.col("weight").between(0, 1)})
    return upserted(old, latest(good, ["term"], ["at"]).select(*old.columns), ["term"])


# --- reports and evaluation ----------------------------------------------------------------


@register("source_rollup", """SELECT o_orderpriority AS source, count(*) AS rules, count(*) FILTER (o_orderstatus = 'F') AS hosts, count(*) FILTER (o_totalprice > 100000) AS severe, max(o_orderdate) AS last_load, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_id FROM orders GROUP BY 1""")
def source_rollup(spark, d):
    return S.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(F.col("o_orderstatus") == "F").alias("hosts"), F.count_if(F.col("o_totalprice") > 100000).alias("severe"),
        F.max("o_orderdate").alias("last_load"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_id"),
    )


_WINDOWED = f"""{S.IMPRESSIONS}, old AS (SELECT query, page_id, max(ts) AS updated FROM impressions GROUP BY 1, 2)"""


@register("ctr_stale", f"""WITH {_WINDOWED} SELECT query, page_id FROM old WHERE updated >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""")
def ctr_stale(spark, d):
    """Rolled-up pairs that are left once those not refreshed for seven days are dropped."""
    rows = S.impressions(spark, d).groupBy("query", "page_id").agg(F.max("ts").alias("updated"))
    return rows.filter(F.col("updated") >= F.lit("2024-01-24").cast("timestamp")).select("query", "page_id")


@register("ctr_window", f"""WITH {S.IMPRESSIONS} SELECT query, page_id, count(*) AS n, count(*) FILTER (clicked) AS clicks FROM impressions WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY 1, 2""")
def ctr_window(spark, d):
    """The roll-up's impressions of a trailing window; what falls out of it is no longer counted."""
    rows = S.impressions(spark, d).filter(F.col("ts") > F.lit("2024-01-17").cast("timestamp"))
    return rows.groupBy("query", "page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("clicked").alias("clicks"))


@register("retention_audit", f"""WITH {S.IMPRESSIONS} SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-10' AND user_id IS NOT NULL) AS overdue_identities, count(*) FILTER (ts < TIMESTAMP '2024-01-04' AND user_id IS NULL) AS overdue_rows, max(ts) AS last_run FROM impressions""")
def retention_audit(spark, d):
    late = lambda day: F.col("ts") < F.lit(day).cast("timestamp")
    return S.impressions(spark, d).agg(
        F.count_if(late("2024-01-10") & F.col("user_id").isNotNull()).alias("overdue_identities"), F.count_if(late("2024-01-04") & F.col("user_id").isNull()).alias("overdue_rows"),
        F.max(F.col("ts").cast("timestamp_ntz")).alias("last_run"),
    )


@register("candidate_ratio", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS word FROM documents),
  m AS (SELECT unnest(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]{2,})', 1)) AS term, doc_id FROM documents), c AS (SELECT lower(term) AS term, count(*) AS caps, count(DISTINCT doc_id) AS pages FROM m GROUP BY 1 HAVING count(DISTINCT doc_id) >= 4),
  l AS (SELECT word AS term, count(*) AS lows FROM w WHERE word = lower(word) GROUP BY 1)
  SELECT c.term, pages, round(coalesce(lows, 0) / (caps + coalesce(lows, 0)), 6) AS lower_ratio FROM c LEFT JOIN l USING (term)""")
def candidate_ratio(spark, d):
    """Words capitalised within sentences on four pages or more, and how often they stand in lower case."""
    docs = _docs(spark, d)
    caps = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z,] ([A-Z][a-z]{2,})"), 1)).alias("term")).withColumn("term", F.lower("term"))
    caps = caps.groupBy("term").agg(F.count(F.lit(1)).alias("caps"), F.countDistinct("doc_id").alias("pages")).filter("pages >= 4")
    lows = docs.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})"), 1)).alias("term")).filter(F.col("term") == F.lower("term")).groupBy("term").agg(F.count(F.lit(1)).alias("lows"))
    n = F.coalesce("lows", F.lit(0))
    return caps.join(lows, "term", "left").select("term", "pages", F.round(n / (F.col("caps") + n), 6).alias("lower_ratio"))


@register("name_contamination", f"""WITH {TERMS}, n AS (SELECT DISTINCT source AS name, unnest(regexp_extract_all(lower(text), '[a-z]{{5,6}}')) AS part FROM documents),
  h AS (SELECT term, list_sort(list(DISTINCT name)) AS names FROM terms JOIN n ON part = term WHERE lang = 'en' GROUP BY 1) SELECT term, len(names) AS n, array_to_string(names[1:6], ',') AS sample FROM h""")
def name_contamination(spark, d):
    """Terms of the English lexicon that are part of a name as well, with how many names and the first six."""
    names = _docs(spark, d).select(F.col("source").alias("name"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,6})"), 1)).alias("part")).distinct()
    met = P.lexicon_terms(spark, d).filter("lang = 'en'").join(names, F.col("part") == F.col("term")).groupBy("term").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return met.select("term", F.size("names").cast("bigint").alias("n"), F.array_join(F.slice("names", 1, 6), ",").alias("sample"))


@register("terciles", """SELECT quality, quantile_disc(s, 1.0 / 3) AS low, quantile_disc(s, 2.0 / 3) AS high FROM (SELECT quality, doc_id % 97 AS s FROM labels) GROUP BY 1""")
def terciles(spark, d):
    from millrace.operators.signals import quantiles

    return quantiles(S.table(spark, d, "labels").select("quality", (F.col("doc_id") % 97).alias("s")), ["quality"], "s", {"low": 1.0 / 3, "high": 2.0 / 3})


@register("gate_sweep", """WITH r AS (SELECT quality = 1 AS wanted, CASE WHEN doc_id % 9 <> 0 THEN (doc_id % 100) / 100.0 END AS best FROM labels), f AS (SELECT unnest([0.5, 0.6, 0.68, 0.8])::DOUBLE AS floor)
  SELECT floor, count(*) FILTER (coalesce(best < floor, true) AND NOT wanted) AS emptied, count(*) FILTER (coalesce(best < floor, true) AND wanted) AS positives_lost FROM r, f GROUP BY 1""")
def gate_sweep(spark, d):
    rows = S.table(spark, d, "labels").select((F.col("quality") == 1).alias("wanted"), F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") % 100 / 100.0).alias("best"))
    return E.gate_sweep(rows, [0.5, 0.6, 0.68, 0.8])


@register("rerank_effect", """SELECT toxic AS type, count(*) AS n, count(*) FILTER (a) AS with_rerank, count(*) FILTER (b) AS without, count(*) FILTER (a AND NOT b) AS helped, count(*) FILTER (b AND NOT a) AS hurt
  FROM (SELECT toxic, doc_id % 7 <> 0 AND doc_id % 23 <= 10 AS a, doc_id % 5 <> 0 AND doc_id % 19 <= 10 AS b FROM labels) GROUP BY 1""")
def rerank_effect(spark, d):
    i = F.col("doc_id")
    rows = S.table(spark, d, "labels").select(F.col("toxic").alias("type"), F.when(i % 7 != 0, i % 23).alias("on"), F.when(i % 5 != 0, i % 19).alias("off"))
    return E.rerank_effect(rows)


@register("preflight", "SELECT unnest(['one model', 'dimension', 'configured model']) AS check, unnest([true, min(len(embedding)) = 64 AND max(len(embedding)) = 64, true]) AS ok FROM embeddings")
def preflight(spark, d):
    rows = S.table(spark, d, "embeddings").select(F.lit("m1").alias("model"), F.size("embedding").alias("dimension"))
    return E.preflight(rows, "m1", 64)


@register("restore_reconcile", "SELECT event_type AS name, count(*) AS live, count(*) FILTER (event_id % 400 <> 7) AS restored FROM events GROUP BY 1 HAVING count(*) <> count(*) FILTER (event_id % 400 <> 7)")
def restore_reconcile(spark, d):
    count = lambda rows: rows.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    e = _events(spark, d)
    return E.reconciled(count(e), count(e.filter("event_id % 400 <> 7")))


_JUDGED = f"""{S.PAGES}, g AS (SELECT page_id, host, tier, text, CASE host WHEN 'src4' THEN 100 WHEN 'src7' THEN 60 END AS severity, CASE WHEN contains(lower(text), 'stupid') THEN 60 ELSE 0 END + CASE WHEN contains(lower(text), 'moron') THEN 60 ELSE 0 END AS words,
    CASE WHEN page_id % 5 <> 0 THEN (page_id % 100) / 100.0 END AS safe FROM pages_v JOIN domains USING (host)),
  v AS (SELECT *, CASE WHEN tier = 'T1' THEN 'safe' WHEN coalesce(severity, 0) >= 100 THEN 'unsafe' WHEN words >= 100 THEN 'unsafe' WHEN tier = 'T2' AND words > 0 THEN 'review' WHEN tier = 'T2' THEN 'safe'
    WHEN safe IS NULL THEN 'unclassified' WHEN safe >= 0.9 THEN 'safe' WHEN safe >= 0.7 THEN 'review' ELSE 'unsafe' END AS judged FROM g)"""


def _judged(spark, d):
    """page_id, host, tier, severity, words, judged: the whole ladder with the severity of blocked hosts."""
    rules = spark.createDataFrame([("src4", "suffix", 100), ("src7", "suffix", 60), ("src14", "host", 0)], "pattern string, match_type string, severity int")
    hosts = X.blocked_hosts(S.domains(spark, d), rules).filter(F.col("host") == F.col("rule")).groupBy("host").agg(F.max("severity").alias("severity"))
    p = S.pages(spark, d).join(S.domains(spark, d), "host").join(hosts, "host", "left")
    words = X.keyword_score(F.col("text"), [("stupid", 60), ("moron", 60)])
    safe = F.when(F.col("page_id") % 5 != 0, F.col("page_id") % 100 / 100.0)
    return p.select("page_id", "host", "tier", "severity", words.alias("words"), X.ladder(F.col("tier"), F.col("severity"), words, safe).alias("judged"))


@register("verdict_applied", f"""WITH {_JUDGED}, s AS (SELECT host FROM v WHERE judged = 'unsafe' GROUP BY 1 HAVING count(*) >= 5)
  SELECT page_id, judged, CASE judged WHEN 'safe' THEN 'indexed' WHEN 'unsafe' THEN 'rejected' ELSE 'quarantined' END AS status, judged IN ('review', 'unclassified') AS review, host IN (SELECT host FROM s) AS purged FROM v""")
def verdict_applied(spark, d):
    """Status of each page, whether it waits for review, and whether its host's strikes purge it."""
    v = _judged(spark, d)
    struck = X.struck_domains(v.withColumnRenamed("judged", "verdict")).select("host", F.lit(True).alias("__struck"))
    return v.join(struck, "host", "left").select(
        "page_id", "judged", X.status_of(F.col("judged")).alias("status"), F.col("judged").isin("review", "unclassified").alias("review"), F.coalesce("__struck", F.lit(False)).alias("purged")
    )


@register("unsafe_scoring", f"""WITH {_JUDGED} SELECT gate, count(*) AS n FROM (SELECT CASE WHEN judged <> 'unsafe' THEN 'admitted' WHEN coalesce(severity, 0) >= 100 THEN 'host' WHEN words >= 100 THEN 'words' ELSE 'model' END AS gate FROM v) GROUP BY 1""")
def unsafe_scoring(spark, d):
    """By which gate a set of pages is rejected first."""
    first = F.when(F.col("judged") != "unsafe", "admitted").when(F.coalesce("severity", F.lit(0)) >= 100, "host").when(F.col("words") >= 100, "words").otherwise("model")
    return _judged(spark, d).groupBy(first.alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@register("family_verdict", """WITH h AS (SELECT doc_id, (doc_id % 100) / 100.0::DOUBLE AS toxic, (doc_id % 61) / 100.0::DOUBLE AS insult, (doc_id % 41) / 50.0::DOUBLE AS gambling, (doc_id % 17) / 20.0::DOUBLE AS news FROM documents),
  f AS (SELECT *, toxic >= 0.8 AS f1, insult >= 0.5 AS f2, gambling >= news AND (gambling >= 0.5 OR gambling >= 0.6) AS f3, greatest(0, greatest(0, toxic - 0.3), insult) AS strongest FROM h)
  SELECT doc_id AS page_id, NOT (f1 OR f2 OR f3) AS safe, round(CASE WHEN f1 OR f2 OR f3 THEN least(1, greatest(strongest, CASE WHEN f3 THEN gambling ELSE 0 END)) ELSE greatest(0, 1 - greatest(strongest, gambling)) END, 3) AS confidence,
    array_to_string(list_filter([CASE WHEN f1 THEN 'toxic' END, CASE WHEN f2 THEN 'insult' END, CASE WHEN f3 THEN 'gambling' END], lambda x: x IS NOT NULL), ',') AS flags FROM f""")
def family_verdict(spark, d):
    i = F.col("doc_id")
    made = A.family_verdict({"toxic": i % 100 / 100.0, "insult": i % 61 / 100.0}, [("gambling", i % 41 / 50.0, True), ("news", i % 17 / 20.0, False)])
    return _docs(spark, d).select(i.alias("page_id"), *(c.alias(n) for n, c in made.items()))


@register("candidate_stage", f"""WITH {S.PAGES}, c AS (SELECT host, count(*) FILTER (verdict IS NOT NULL) AS probed, count(*) FILTER (verdict = 'safe') AS passed FROM pages_v JOIN domains USING (host) WHERE tier = 'T0' GROUP BY 1)
  SELECT host, CASE WHEN host = 'src4' THEN 'screened out' WHEN probed = 0 THEN 'to probe' WHEN probed < 5 THEN 'waiting' WHEN passed / probed >= 0.9 THEN 'promoted' ELSE 'rejected' END AS stage FROM c""")
def candidate_stage(spark, d):
    """Where each candidate host stands: screened out by a rule, to be probed, waiting for more pages, promoted or rejected."""
    p = S.pages(spark, d).join(S.domains(spark, d).filter("tier = 'T0'"), "host")
    rules = spark.createDataFrame([("src4", "suffix", 100)], "pattern string, match_type string, severity int")
    hosts = p.select("host").distinct()
    blocked = X.blocked_hosts(hosts, rules).filter(F.col("host") == F.col("rule")).select("host", F.lit(True).alias("__blocked"))
    probed = X.probe_outcome(p).select("host", "outcome")
    return hosts.join(blocked, "host", "left").join(probed, "host", "left").select("host", F.when(F.col("__blocked"), "screened out").otherwise(F.coalesce("outcome", F.lit("to probe"))).alias("stage"))


@register("tier_cascade", f"""WITH {S.PAGES}, b AS (SELECT page_id, host, unnest(string_split(text, chr(10))) AS block FROM pages_v) SELECT page_id, tier, count(*) AS blocks FROM b JOIN domains USING (host) WHERE block <> '' GROUP BY 1, 2""")
def tier_cascade(spark, d):
    """Blocks take their page's tier by join, never by a copy that could go stale."""
    blocks = S.pages(spark, d).select("page_id", "host", F.explode(F.split("text", "\n")).alias("block")).filter("block <> ''")
    return blocks.join(S.domains(spark, d), "host").groupBy("page_id", "tier").agg(F.count(F.lit(1)).alias("blocks"))


@register("doubled_articles", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])(the the|a a|an an|le le|la la)($|[^\\p{L}\\p{N}])')")
def doubled_articles(spark, d):
    return _docs(spark, d).filter(F.col("text").rlike("(?i)(^|[^\\p{L}\\p{N}])(the the|a a|an an|le le|la la)($|[^\\p{L}\\p{N}])")).select("doc_id")


@register("constraint_check", f"""WITH {_SITES} SELECT host, array_to_string(list_filter([CASE WHEN id % 9 = 0 AND tier <> 'T1' THEN 'zone A needs the first tier' END, CASE WHEN id % 200 > 160 THEN 'blurb too long' END, CASE WHEN id % 4 = 3 THEN 'unknown match type' END], lambda x: x IS NOT NULL), ';') AS errors FROM sites""")
def constraint_check(spark, d):
    """Rows of a write that break a constraint, with all that they break."""
    from millrace.sources.articles import validated

    i = F.col("id")
    rows = _sites(spark, d).select("host", "tier", (i % 9 == 0).alias("zone_a"), (i % 200).alias("blurb"), F.when(i % 4 == 3, "fuzzy").otherwise("exact").alias("match_type"))
    rules = {"zone A needs the first tier": ~F.col("zone_a") | (F.col("tier") == "T1"), "blurb too long": F.col("blurb") <= 160, "unknown match type": F.col("match_type").isin("exact", "contains", "regex")}
    good, bad = validated(rows, rules)
    return good.select("host", F.lit("").alias("errors")).unionByName(bad.select("host", F.array_join("errors", ";").alias("errors")))


@register("sample_percent", """WITH h AS (SELECT doc_id, CAST('0x' || substr(md5('review:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents) SELECT doc_id FROM h WHERE h < 42949672 OR h = (SELECT min(h) FROM h)""")
def sample_percent(spark, d):
    """One page in a hundred for review, at least one, the same in every run."""
    return A.sampled(_docs(spark, d), "doc_id", 1.0, "review").select("doc_id")


@register("embedding_progress", """SELECT CASE WHEN vec_id % 3 = 0 THEN 'm2' WHEN vec_id % 3 = 1 THEN 'm1' ELSE 'none' END AS model, count(*) AS chunks, count(*) FILTER (vec_id % 3 < 2) AS done, count(*) FILTER (vec_id % 3 = 2) AS pending FROM embeddings GROUP BY 1""")
def embedding_progress(spark, d):
    i = F.col("vec_id")
    rows = S.table(spark, d, "embeddings").select(F.when(i % 3 < 2, F.col("embedding")).alias("embedding"), F.when(i % 3 == 0, "m2").when(i % 3 == 1, "m1").alias("model"))
    return M.progress(rows, F.col("model"))


@register("reembed", "SELECT vec_id, CASE WHEN label = 2 THEN NULL ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def reembed(spark, d):
    """Vectors of a group are dropped, to be made anew; the others stay."""
    held = S.table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("label") != 2, F.col("embedding")))
    return held.select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@register("embed_chunks")
def embed_chunks(spark, d):
    """Every document's vector from the stand-in provider: model, attempts, dimension and length of the vector."""
    chunks = _docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.lit("").alias("title"), F.col("lang").alias("heading"), "text")
    made = M.embedded(chunks, M.hashed_provider(16), "hashed-16")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return made.select("chunk_id", "model", "attempts", F.size("embedding").alias("dimension"), F.round(norm, 4).alias("length"))


@register("vector_ann")
def vector_ann(spark, d):
    """The nearest ten of every vector whose id 50 divides, by an inverted file: lists for the square root of the vectors, half of them probed."""
    v = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("page_id"), "embedding")
    lists = max(1, round(v.count() ** 0.5))
    middle = M.centroids(v, lists)
    asked = v.filter("page_id % 50 = 0").withColumnRenamed("page_id", "query_id")
    return M.nearest(v, asked, middle, probes=max(1, lists // 2), limit=10).select("query_id", "page_id", F.round("cosine", 6).alias("cosine"))


@register("concept_hits", f"""WITH {TERMS}, q AS (SELECT item_id AS query_id, list_distinct({WORDS.format('text')}) AS w FROM benchmark) SELECT concept, count(DISTINCT query_id) AS queries, count(*) AS hits FROM q JOIN terms ON list_contains(w, term) GROUP BY 1""")
def concept_hits(spark, d):
    """How many queries touch each concept of the lexicon."""
    each = P.asked(spark, d).select("query_id", F.explode("tokens").alias("term")).join(P.lexicon_terms(spark, d), "term")
    return each.groupBy("concept").agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("hits"))


@register("retry_after", """SELECT event_id, n > 2 AS refused, CASE WHEN n > 2 THEN ceil(7200 - (epoch_us(ts) - epoch_us(third)) / 1000000.0)::BIGINT END AS retry_after_s
  FROM (SELECT event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECONDS PRECEDING AND CURRENT ROW) AS n, lag(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS third FROM events)""")
def retry_after(spark, d):
    """Refused requests with the seconds until the window has room again."""
    from millrace.operators.retention import rate_limited

    return rate_limited(_events(spark, d), "user_id", "ts", 7200, 2, tie="event_id").select("event_id", "refused", "retry_after_s")


@register("deep_links", f"""WITH {SERVED} SELECT host, page_id, CAST(row_number() OVER (PARTITION BY host ORDER BY page_id % 100 DESC, n_chars DESC, page_id) AS INT) AS place FROM served QUALIFY place <= 3""")
def deep_links(spark, d):
    """The three pages of each host with most engagement, then most text."""
    served = gate.servable(S.pages(spark, d), S.domains(spark, d))
    return C.latest_of(served, "host", [(F.col("page_id") % 100).desc(), F.col("n_chars").desc(), F.col("page_id")], 3).select("host", "page_id", "place")


@register("remote_listing", """SELECT n_name AS path, CASE WHEN n_nationkey % 5 = 0 THEN 'withdraw' WHEN n_nationkey % 3 = 0 OR n_nationkey % 4 = 1 THEN 'fetch' ELSE 'keep' END AS step FROM nation""")
def remote_listing(spark, d):
    """Which files of a remote tree are fetched: new and changed ones; those that are gone are withdrawn."""
    from millrace.sources.articles import to_fetch

    n, k = S.table(spark, d, "nation"), F.col("n_nationkey")
    known = n.filter((k % 3 != 0) | (k % 5 == 0)).select(F.col("n_name").alias("path"), F.md5("n_name").alias("sha"))
    listing = n.filter(k % 5 != 0).select(F.col("n_name").alias("path"), F.when(k % 4 == 1, F.md5(F.lower("n_name"))).otherwise(F.md5("n_name")).alias("sha"))
    return to_fetch(known, listing)


@register("migrations", """SELECT n_nationkey AS version, CASE WHEN n_nationkey >= 20 THEN 'pending' WHEN n_nationkey % 10 = 1 THEN 'changed' ELSE 'applied' END AS state FROM nation""")
def migrations(spark, d):
    from millrace.sources.articles import pending

    n, k = S.table(spark, d, "nation"), F.col("n_nationkey")
    wanted = n.select(k.alias("version"), F.md5("n_name").alias("checksum"))
    applied = n.filter(k < 20).select(k.alias("version"), F.when(k % 10 == 1, F.lit("other")).otherwise(F.md5("n_name")).alias("checksum"))
    return pending(wanted, applied)


@register("analytics_pull", """SELECT user_id AS url, max(value) FILTER (event_type = 'view') AS dwell, max(value) FILTER (event_type = 'click') AS scroll FROM (
  SELECT * FROM events WHERE event_type IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1""")
def analytics_pull(spark, d):
    """The last value of each measure that an analytics source reported for a URL."""
    rows = _events(spark, d).select(
        F.col("user_id").alias("url"), "ts", "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("dwell"), F.when(F.col("event_type") == "click", F.col("value")).alias("scroll")
    )
    return A.filled(rows.filter("dwell IS NOT NULL OR scroll IS NOT NULL"), ["url"], ["ts", "event_id"], ["dwell", "scroll"])
