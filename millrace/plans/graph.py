"""Identity, safety, links, crawl policy and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import evaluation as E
from millrace.operators import identity as I
from millrace.operators import safety as X
from millrace.operators.shared import written
from millrace.plans.registry import register
from millrace.plans.search import SEMANTIC, WORDS, ZONED, semantic
from millrace.sources import tables as S


@register("content_hash", """SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents""")
def content_hash(spark, d):
    return S.table(spark, d, "documents").select("doc_id", U.content_hash(F.col("text")).alias("digest"))


@register("exact_dedupe", f"""WITH {S.PAGES}, h AS (SELECT page_id, tier, first_seen, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM pages_v JOIN domains USING (host)),
  r AS (SELECT page_id, first_value(page_id) OVER (PARTITION BY digest ORDER BY CASE WHEN tier = 'T1' THEN 0 ELSE 1 END, first_seen, page_id) AS duplicate_of FROM h)
  SELECT page_id, duplicate_of FROM r WHERE page_id <> duplicate_of""")
def exact_dedupe(spark, d):
    p = S.pages(spark, d).join(S.domains(spark, d), "host").select("page_id", F.when(F.col("tier") == "T1", 0).otherwise(1).alias("owned"), "first_seen", U.content_hash(F.col("text")).alias("digest"))
    return I.exact_duplicates(p, "digest", ["owned", "first_seen"]).select("page_id", "duplicate_of")


#: Documents, and a tenth of them crawled again with a line put under them.
_CRAWLED = "crawled AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, text || ' Read more.' FROM documents WHERE doc_id % 10 = 0)"
_SIM_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
_SIMHASH = f"""{_CRAWLED}, w AS (SELECT doc_id, {_SIM_WORDS} AS w FROM crawled),
  s AS (SELECT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
  g AS (SELECT doc_id, s, least(count(*), 3) AS n, CAST('0x' || substr(sha256(s), 1, 16) AS UBIGINT) AS h FROM s GROUP BY doc_id, s),
  b AS (SELECT doc_id, bit, sum(CASE WHEN (h >> bit) & 1 = 1 THEN n ELSE -n END) AS v FROM g, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS bit) GROUP BY doc_id, bit),
  sim AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN CAST(1 AS HUGEINT) << CAST(bit AS INT) ELSE 0 END) AS u FROM b GROUP BY doc_id),
  f AS (SELECT doc_id, CAST(CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END AS BIGINT) AS simhash FROM sim)"""


def _crawled(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    again = docs.filter("doc_id % 10 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.concat("text", F.lit(" Read more.")).alias("text"))
    return docs.unionByName(again)


def _fingerprints(spark, d):
    return I.simhashes(_crawled(spark, d), "doc_id", F.col("text"))


@register("simhash", f"WITH {_SIMHASH} SELECT doc_id, coalesce(simhash, 0) AS simhash FROM crawled LEFT JOIN f USING (doc_id)")
def simhash(spark, d):
    return _fingerprints(spark, d)


_PAIRS = f"{_SIMHASH}, u AS (SELECT DISTINCT coalesce(simhash, 0) AS simhash FROM crawled LEFT JOIN f USING (doc_id)), pairs AS (SELECT x.simhash AS a, y.simhash AS b, CAST(bit_count(xor(x.simhash, y.simhash)) AS INT) AS distance FROM u x JOIN u y ON x.simhash < y.simhash AND bit_count(xor(x.simhash, y.simhash)) <= 3)"


@register("near_dup_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def near_dup_pairs(spark, d):
    return I.near_pairs(written(_fingerprints(spark, d), "simhashes"))


@register("near_dup_resolve", f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT simhash, simhash FROM u),
  reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), heads AS (SELECT a AS simhash, min(b) AS grp FROM reach GROUP BY 1),
  m AS (SELECT doc_id, grp, min(doc_id) OVER (PARTITION BY grp) AS first FROM crawled LEFT JOIN f USING (doc_id) JOIN heads ON heads.simhash = coalesce(f.simhash, 0))
  SELECT doc_id AS page_id, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM m""")
def near_dup_resolve(spark, d):
    """Each page with the page that stands for its component of near copies."""
    prints = written(_fingerprints(spark, d), "simhashes")
    pairs = written(I.near_pairs(prints), "near-pairs")
    return I.resolved(prints.select(F.col("doc_id").alias("page_id"), "simhash"), pairs, [])


@register("canonical_pick", f"""WITH {S.PAGES} SELECT title, page_id AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END,
  CASE tier WHEN 'T1' THEN 0 WHEN 'T2' THEN 1 ELSE 2 END, first_seen, page_id) AS k FROM pages_v JOIN domains USING (host)) WHERE k = 1""")
def canonical_pick(spark, d):
    p = S.pages(spark, d).join(S.domains(spark, d), "host").withColumns({"url": F.lit("u"), "canonical_url": F.when(F.col("page_id") % 3 == 0, "u")})
    return I.canonical(p, "title")


_BLOCKS = "blocks AS (SELECT DISTINCT doc_id AS page_id, source AS host, unnest(string_split(text, chr(10))) AS block FROM documents)"


def _blocks(spark, d):
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("host"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("block"))


@register("block_boilerplate", f"WITH {_BLOCKS} SELECT host, block, count(DISTINCT page_id) AS pages FROM blocks GROUP BY 1, 2 HAVING count(DISTINCT page_id) >= 3")
def block_boilerplate(spark, d):
    return I.repeated_blocks(_blocks(spark, d))


@register("chunk_boilerplate", f"""WITH {_BLOCKS}, r AS (SELECT host, block FROM blocks GROUP BY 1, 2 HAVING count(DISTINCT page_id) >= 3)
  SELECT page_id, count(*) AS kept FROM blocks b WHERE regexp_matches(block, '^(# |[-*+] )') OR NOT EXISTS (SELECT 1 FROM r WHERE r.host = b.host AND r.block = b.block) GROUP BY 1""")
def chunk_boilerplate(spark, d):
    blocks = _blocks(spark, d)
    return I.without_boilerplate(blocks, I.repeated_blocks(blocks)).groupBy("page_id").agg(F.count(F.lit(1)).alias("kept"))


_LINKS = """links AS (SELECT page_id AS from_page, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1)) AS href FROM pages)"""


@register("inlinks", f"""WITH {_LINKS}, w AS (SELECT DISTINCT href AS key FROM links), k AS (SELECT key FROM w UNION ALL SELECT '/nowhere')
  SELECT key, count(DISTINCT from_page) AS inlinks FROM k LEFT JOIN links ON href = key GROUP BY key""")
def inlinks(spark, d):
    links = S.table(spark, d, "pages").select(F.col("page_id").alias("from_page"), F.explode(F.regexp_extract_all("html", F.lit('<a[^>]+href="([^"]*)"'), 1)).alias("to"))
    keys = links.select(F.col("to").alias("key")).distinct().union(spark.createDataFrame([("/nowhere",)], "key string"))
    return I.inlinks(keys.withColumn("page_id", F.col("key")), links).select(F.col("page_id").alias("key"), "inlinks")


def _edges(spark, d):
    """A trust graph from orders: a supplier's nation links to the part brands it ships."""
    li, sup, part = (S.table(spark, d, t) for t in ("lineitem", "supplier", "part"))
    rows = li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.concat(F.lit("src"), (F.col("s_suppkey") % 20).cast("string")).alias("from_host"),
        F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")).alias("to_host"),
        F.concat(F.lit("https://x/"), F.col("p_partkey").cast("string")).alias("to_url"),
        F.when(F.col("l_linenumber") % 2 == 0, "nofollow").alias("rel"),
        (F.col("l_linenumber") == 1).alias("is_internal"),
    )


@register("trust_nominate", f"""WITH {S.DOMAINS}, e AS (SELECT 'src' || (s_suppkey % 20) AS from_host, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS to_host, 'https://x/' || p_partkey AS to_url
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 1 AND l_linenumber % 2 = 1),
  t AS (SELECT to_host, from_host, min(to_url) AS sample FROM e JOIN domains ON host = from_host WHERE tier IN ('T1', 'T2') AND status = 'active' GROUP BY 1, 2)
  SELECT to_host AS host, count(*) AS linking_domains, array_to_string(list(from_host ORDER BY from_host), ',') AS linking_hosts, array_to_string(list(sample ORDER BY sample)[1:5], ',') AS samples
  FROM t WHERE to_host <> 'brand11' GROUP BY 1 HAVING count(*) >= 3""")
def trust_nominate(spark, d):
    decided = spark.createDataFrame([("brand11",)], "host string")
    out = X.nominated(_edges(spark, d), S.domains(spark, d), decided)
    return out.withColumn("linking_hosts", F.array_join("linking_hosts", ",")).withColumn("samples", F.array_join("samples", ","))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '')"
_RULES = [("example.com", "host", 60), ("example.net", "host", 100), (".org", "suffix", 40), ("safe.example.com", "host", 0)]


def _rules(spark):
    return spark.createDataFrame(_RULES, "pattern string, match_type string, severity int")


@register("host_parents_block", f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), r AS (SELECT * FROM (VALUES {', '.join(map(str, _RULES))}) r(pattern, match_type, severity)),
  j AS (SELECT host FROM h WHERE host NOT IN (SELECT pattern FROM r WHERE severity = 0 AND match_type = 'host')),
  c AS (SELECT host, p AS pattern FROM (SELECT host, string_split(host, '.') AS l FROM j), LATERAL (SELECT unnest(list_transform(range(1, len(l)), lambda i: array_to_string(l[i:], '.'))) AS p))
  SELECT host, pattern AS rule, severity FROM c JOIN r USING (pattern) WHERE match_type = 'host' AND severity > 0
  UNION ALL SELECT host, pattern, severity FROM j JOIN r ON match_type = 'suffix' AND ends_with(host, pattern)""")
def host_parents_block(spark, d):
    hosts = S.table(spark, d, "pages").select(U.host_of(F.col("url")).alias("host"))
    return X.blocked_hosts(hosts, _rules(spark))


@register("safety_ladder", f"""WITH {S.PAGES}, w AS (SELECT page_id, host, tier, CASE WHEN contains(lower(text), 'stupid') THEN 60 ELSE 0 END + CASE WHEN contains(lower(text), 'moron') THEN 60 ELSE 0 END AS words,
    CASE WHEN page_id % 5 <> 0 THEN (page_id % 100) / 100.0 END AS safe FROM pages_v JOIN domains USING (host)),
  v AS (SELECT page_id, CASE WHEN tier = 'T1' THEN 'safe' WHEN words >= 100 THEN 'unsafe' WHEN tier = 'T2' AND words > 0 THEN 'review' WHEN tier = 'T2' THEN 'safe'
    WHEN safe IS NULL THEN 'unclassified' WHEN safe >= 0.9 THEN 'safe' WHEN safe >= 0.7 THEN 'review' ELSE 'unsafe' END AS verdict FROM w)
  SELECT page_id, verdict, CASE verdict WHEN 'safe' THEN 'indexed' WHEN 'unsafe' THEN 'rejected' ELSE 'quarantined' END AS status FROM v""")
def safety_ladder(spark, d):
    p = S.pages(spark, d).join(S.domains(spark, d), "host")
    words = X.keyword_score(F.col("text"), [("stupid", 60), ("moron", 60)])
    safe = F.when(F.col("page_id") % 5 != 0, (F.col("page_id") % 100) / 100.0)
    v = p.select("page_id", X.ladder(F.col("tier"), F.lit(None).cast("int"), words, safe).alias("verdict"))
    return v.withColumn("status", X.status_of(F.col("verdict")))


@register("strikes", f"WITH {S.PAGES} SELECT host, count(*) AS strikes FROM pages_v WHERE verdict = 'unsafe' GROUP BY 1 HAVING count(*) >= 5")
def strikes(spark, d):
    return X.struck_domains(S.pages(spark, d))


@register("probe_promotion", f"""WITH {S.PAGES}, c AS (SELECT host, count(*) AS probed, count(*) FILTER (verdict = 'safe') AS passed FROM pages_v WHERE verdict IS NOT NULL GROUP BY 1)
  SELECT *, CASE WHEN probed < 5 THEN 'waiting' WHEN passed / probed >= 0.9 THEN 'promoted' ELSE 'rejected' END AS outcome FROM c""")
def probe_promotion(spark, d):
    return X.probe_outcome(S.pages(spark, d))


@register("url_normal", """SELECT page_id, CASE WHEN h = '' THEN trim(url) ELSE 'https://' || regexp_replace(lower(h), '^www\\.', '') ||
    CASE WHEN p = '' OR p = '/' THEN '/' ELSE regexp_replace(p, '/$', '') END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS normal
  FROM (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1) AS h, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '(?i)^(utm_.*|fbclid|gclid|msclkid|mc_eid|ref)$'))), '&') AS q FROM pages)""")
def url_normal(spark, d):
    return S.table(spark, d, "pages").select("page_id", U.normalized_url(F.col("url")).alias("normal"))


@register("admission", f"""SELECT page_id, CASE WHEN {_HOST} <> 'example.com' AND NOT ends_with({_HOST}, '.example.com') THEN 'off-domain' WHEN page_id % 9 > 6 THEN 'too deep'
  WHEN regexp_matches(url, '/(wp-admin|cart|login|feed|print|amp)(/|$)') THEN 'crawler trap path'
  WHEN regexp_matches(url, '(?i)[?&](sessionid|phpsessid|jsessionid|sid|replytocom|share|print|utm_|fbclid|gclid)') THEN 'trap parameter' END AS reason FROM pages""")
def admission(spark, d):
    reason = U.refusal(F.col("url"), F.lit("example.com"), F.col("page_id") % 9, F.lit(6))
    return S.table(spark, d, "pages").select("page_id", reason.alias("reason"))


@register("adaptive_interval", """SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 THEN greatest(24, round(h / 2.0)) WHEN doc_id % 7 < 3 THEN h ELSE least(720, round(h * 1.5)) END AS INT) AS hours
  FROM (SELECT doc_id, CAST(24 + doc_id % 600 AS INT) AS h FROM documents)""")
def adaptive_interval(spark, d):
    i = F.col("doc_id")
    hours = U.next_interval((24 + i % 600).cast("int"), F.lit(24), i % 7, i % 4 == 0)
    return S.table(spark, d, "documents").select("doc_id", hours.cast("int").alias("hours"))


@register("ngram_df", f"""WITH w AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark), g AS (SELECT item_id, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) AS gram FROM w)
  SELECT gram, count(*) AS n, count(DISTINCT item_id) AS df FROM g GROUP BY 1""")
def ngram_df(spark, d):
    words = T.words(T.normalized(F.col("text")))
    grams = S.table(spark, d, "benchmark").select("item_id", F.explode(F.concat(words, T.ngrams(words, 2), T.ngrams(words, 3))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("df"))


@register("candidate_terms", """WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]{2,})', 1)) AS term FROM documents)
  SELECT term, count(DISTINCT doc_id) AS pages FROM m GROUP BY 1 HAVING count(DISTINCT doc_id) >= 4""")
def candidate_terms(spark, d):
    m = S.table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z,] ([A-Z][a-z]{2,})"), 1)).alias("term"))
    return m.groupBy("term").agg(F.countDistinct("doc_id").alias("pages")).filter("pages >= 4")


@register("bridging", """SELECT lang, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (a AND b) AS both, count(*) FILTER (a OR b) AS either
  FROM (SELECT lang, contains(text, 'the ') AS a, contains(text, 'and ') AS b FROM documents) GROUP BY lang""")
def bridging(spark, d):
    a, b = F.contains("text", F.lit("the ")), F.contains("text", F.lit("and "))
    return S.table(spark, d, "documents").groupBy("lang").agg(F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"), F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"))


def _skeleton_sql(term: str) -> str:
    """DuckDB: ``functions.text.skeleton``; doubled letters go letter by letter, as RE2 has no back-references."""
    out = f"regexp_replace(substr({term}, 2), '[aeiouy]', '', 'g')"
    for c in "bcdfghjklmnpqrstvwxz":
        out = f"regexp_replace({out}, '{c}{c}+', '{c}', 'g')"
    return f"substr({term}, 1, 1) || {out}"


_TERM_LIST = f"""t AS (SELECT term, {_skeleton_sql('term')} AS k FROM (SELECT DISTINCT unnest({WORDS.format('text')}) AS term FROM benchmark) WHERE regexp_full_match(term, '[a-z]{{4,}}'))"""


@register("edit_distance", f"""WITH {_TERM_LIST} SELECT x.term AS a, y.term AS b, CAST(levenshtein(x.term, y.term) AS INT) AS distance FROM t x JOIN t y USING (k) WHERE x.term < y.term AND levenshtein(x.term, y.term) <= 3""")
def edit_distance(spark, d):
    """Words that may be spellings of one another: of one skeleton, at most three edits apart."""
    words = S.table(spark, d, "benchmark").select(F.explode(T.words(T.normalized(F.col("text")))).alias("t")).distinct().filter(F.col("t").rlike("^[a-z]{4,}$"))
    t = words.withColumn("k", T.skeleton(F.col("t")))
    pairs = t.withColumnRenamed("t", "a").join(t.withColumnRenamed("t", "b"), "k").filter("a < b")
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance")).filter("distance <= 3")


_RANKED = f"""WITH {ZONED}, {SEMANTIC}, gold AS (SELECT vec_id // 50 AS query_id, vec_id, label FROM embeddings WHERE vec_id % 50 = 0),
  r AS (SELECT s.query_id, min(s.sem_rank) AS rank FROM sem s JOIN gold g USING (query_id) JOIN embeddings e ON e.vec_id = s.page_id WHERE e.label = g.label AND e.vec_id <> g.vec_id GROUP BY 1)"""


def _ranks(spark, d):
    e = S.table(spark, d, "embeddings")
    gold = e.filter("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("bigint").alias("query_id"), F.col("vec_id").alias("own"), "label")
    hits = semantic(spark, d).join(gold, "query_id").join(e.select(F.col("vec_id").alias("page_id"), F.col("label").alias("found")), "page_id")
    ranks = hits.filter("found = label AND page_id <> own").groupBy("query_id").agg(F.min("sem_rank").cast("bigint").alias("rank"))
    return gold.join(ranks, "query_id", "left")


@register("recall_metrics", _RANKED + """, a AS (SELECT g.label, r.rank FROM gold g LEFT JOIN r USING (query_id))
  SELECT label, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3,
  round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr,
  quantile_disc(rank, 0.5) AS median_rank FROM a GROUP BY label""")
def recall_metrics(spark, d):
    return E.recall(_ranks(spark, d), "label")


@register("threshold_curve", """WITH s AS (SELECT doc_id, quality, (doc_id % 50) / 50.0 AS score FROM labels), f AS (SELECT DISTINCT score AS floor FROM s)
  SELECT floor::DOUBLE AS floor, count(*) FILTER (quality = 1 AND score >= floor) AS kept, count(*) FILTER (quality = 1 AND score < floor) AS lost,
  count(*) FILTER (quality = 0 AND score >= floor) AS admitted, count(*) FILTER (quality = 0 AND score < floor) AS blocked FROM f, s GROUP BY floor""")
def threshold_curve(spark, d):
    rows = S.table(spark, d, "labels").select((F.col("doc_id") % 50 / 50.0).alias("score"), (F.col("quality") == 1).alias("wanted"))
    return E.threshold_curve(rows)


@register("blend_sweep", """WITH r AS (SELECT doc_id, (doc_id % 37) / 37.0 AS a, (doc_id % 11) / 11.0 AS b, quality FROM labels), w AS (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS w),
  s AS (SELECT w, doc_id, quality, row_number() OVER (PARTITION BY w ORDER BY round((1 - w) * a + w * b, 9) DESC, doc_id) AS k FROM r, w)
  SELECT w, CAST(sum(quality) FILTER (k <= 10) AS BIGINT) AS good FROM s GROUP BY w""")
def blend_sweep(spark, d):
    rows = S.table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 37 / 37.0).alias("a"), (F.col("doc_id") % 11 / 11.0).alias("b"), "quality")
    return E.blend(rows, [0.0, 0.25, 0.5, 1.0], 10)


@register("run_compare", """SELECT coalesce(a.doc_id, b.doc_id) AS pair, CASE WHEN a.r IS NULL THEN 'gained' WHEN b.r IS NULL THEN 'lost' WHEN a.r <> b.r THEN 'moved' ELSE 'same' END AS change
  FROM (SELECT doc_id, doc_id % 7 AS r FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, doc_id % 3 AS r FROM labels WHERE doc_id % 4 <> 0) b ON a.doc_id = b.doc_id""")
def run_compare(spark, d):
    l = S.table(spark, d, "labels")
    a = l.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("pair"), (F.col("doc_id") % 7).alias("rank"))
    b = l.filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("pair"), (F.col("doc_id") % 3).alias("rank"))
    return E.compare(a, b).select("pair", "change")


@register("failure_verdict", """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'RETRIEVAL' WHEN doc_id % 120 <= 50 THEN 'RANKING' ELSE 'DEEP' END AS verdict FROM labels""")
def failure_verdict(spark, d):
    rank = F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 120)
    return S.table(spark, d, "labels").select("doc_id", E.verdict(rank).alias("verdict"))
