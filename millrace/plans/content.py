"""Content queries: extraction, chunking, robots, Markdown, feeds, entities, webhooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.registry import register
from millrace.plans.search import snippet_sql
from millrace.sources import articles as A
from millrace.sources import tables as S
from millrace.sources import web


def markdown_sql(text: str) -> str:
    """DuckDB: ``functions.text.stripped_markdown``."""
    for pattern, to in T.MARKDOWN:
        text = f"regexp_replace({text}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"


@register("html_extract")
def html_extract(spark, d):
    return web.extracted(S.table(spark, d, "pages"))


@register("html_titles", """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a [^>]*href="[^"]+"')) AS INT) AS n_links FROM pages""")
def html_titles(spark, d):
    return web.extracted(S.table(spark, d, "pages")).select("page_id", F.coalesce("lang", F.lit("")).alias("lang"), "n_links")


@register("chunk_pages")
def chunk_pages(spark, d):
    return A.chunked(S.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))


@register("token_estimate", """SELECT doc_id, CAST(ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.35::DOUBLE) AS BIGINT) AS tokens FROM documents""")
def token_estimate(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


_ROBOTS = "User-agent: *\nDisallow: /t\nAllow: /the$\nUser-agent: millbot\nDisallow: /a*n\n"


@register("robots_check", """SELECT page_id, path, NOT starts_with(path, '/t') OR path = '/the' AS anyone, NOT regexp_matches(path, '^/a.*n') AS named
  FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS path FROM pages)""")
def robots_check(spark, d):
    """Paths of page links against a robots.txt with groups, wildcards and an exception; each distinct path is judged once."""
    rows = S.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1)).alias("path"))

    def check(batches):
        anyone, named = (web.robots_rules(_ROBOTS, agent) for agent in ("other", "millbot/1.0"))
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "anyone": list(map(anyone, batch["path"])), "named": list(map(named, batch["path"]))})

    judged = rows.select("path").distinct().mapInPandas(check, "path string, anyone boolean, named boolean")
    return rows.join(judged, "path").select("page_id", "path", "anyone", "named")


@register("markdown_plain", f"""SELECT doc_id, {markdown_sql("'## ' || lang || chr(10) || '> ' || text || chr(10) || '- **' || source || '** [' || lang || '](http://x) ![alt](y) | a | `b` |' || chr(10) || '---' || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```'")} AS plain FROM documents""")
def markdown_plain(spark, d):
    """Plain text of documents wrapped in headings, quotes, lists, links, images, tables, rules and code."""
    wrapped = F.concat(F.lit("## "), "lang", F.lit("\n> "), "text", F.lit("\n- **"), "source", F.lit("** ["), "lang", F.lit("](http://x) ![alt](y) | a | `b` |\n---\n```\ncode\n```"))
    return S.table(spark, d, "documents").select("doc_id", T.stripped_markdown(wrapped).alias("plain"))


@register("front_matter", """SELECT doc_id, lang || '-' || source AS title, 3 AS n_tags, text AS body FROM documents""")
def front_matter(spark, d):
    docs = S.table(spark, d, "documents")
    raw = F.concat(F.lit('---\ntitle: "'), "lang", F.lit("-"), "source", F.lit('"\ntags: [a, b, '), "lang", F.lit("]\n---\n"), "text")
    page = A.mapped_page(raw)
    return docs.select("doc_id", page["title"].alias("title"), F.size(page["tags"]).alias("n_tags"), page["body"].alias("body"))


@register("slugs", f"""SELECT item_id, regexp_replace(regexp_replace(translate(lower(trim(split_part(text, chr(10), 1))), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM benchmark""")
def slugs(spark, d):
    return S.table(spark, d, "benchmark").select("item_id", A.slug(F.substring_index("text", "\n", 1)).alias("slug"))


@register("feed_since", """SELECT event_id AS id, ts AS updated_at FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-20', 10)""")
def feed_since(spark, d):
    feed = S.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("updated_at"))
    return A.feed_changes(feed, ("2024-01-20", 10))


@register("entity_merge", """SELECT coalesce(a.k, b.k) AS entity_key, coalesce(b.n, a.n) AS name, b.k IS NOT NULL AS active
  FROM (SELECT n_name AS k, n_name AS n FROM nation WHERE n_nationkey % 3 <> 0) a FULL JOIN (SELECT n_name AS k, lower(n_name) AS n FROM nation WHERE n_nationkey % 2 = 0) b ON a.k = b.k""")
def entity_merge(spark, d):
    n = S.table(spark, d, "nation")
    old = n.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("entity_key"), F.col("n_name").alias("name"))
    new = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("entity_key"), F.lower("n_name").alias("name"))
    return A.merged_entities(old, new)


@register("import_validation", """SELECT c_custkey, c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY' AS accepted FROM customer""")
def import_validation(spark, d):
    good, bad = A.validated(S.table(spark, d, "customer"), {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "MACHINERY"})
    return good.select("c_custkey", F.lit(True).alias("accepted")).unionByName(bad.select("c_custkey", F.lit(False).alias("accepted")))


@register("snippets", f"SELECT doc_id, {snippet_sql('text', 160)} AS snippet FROM documents")
def snippets(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), 160).alias("snippet"))
