"""Search queries: normal forms, candidates, fusion, zones, lexicon, suggestions, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scripture
from millrace.functions import text as T
from millrace.operators import gate, lexicon
from millrace.operators import retrieval as R
from millrace.plans.registry import register
from millrace.sources import articles as A
from millrace.sources import tables as S

#: DuckDB: the normal form of a text column ``{0}``.
NORM = (
    "trim(regexp_replace(regexp_replace(translate(lower(trim(coalesce({0}, ''))), '"
    + T.ACCENTED
    + "', '"
    + T.PLAIN
    + "'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"
)
WORDS = "list_filter(string_split(" + NORM + ", ' '), lambda w: w <> '')"

def stem_sql(words: str, lang: str) -> str:
    """DuckDB: ``functions.text.stemmed``."""
    cases = " ".join(f"WHEN '{code}' THEN list_transform({words}, lambda x: regexp_replace(x, '^(.{{{T.LEAST_STEM},}}?)({endings})$', '\\1'))" for code, endings in T.ENDINGS.items())
    return f"CASE {lang} {cases} ELSE {words} END"


_VOTE = {lang: f"len(list_intersect(w, {stops.split()!r}))" for lang, stops in T.STOPWORDS.items()}
#: DuckDB: the language that most words of the distinct list ``w`` vote for.
LANG = f"""CASE WHEN greatest({', '.join(_VOTE.values())}) = 0 THEN 'en' {' '.join(f"WHEN {v} = greatest({', '.join(_VOTE.values())}) THEN '{k}'" for k, v in _VOTE.items())} END"""
_HEADS = " ".join(f"WHEN '{code}' THEN {heads!r}" for code, heads in T.INTERROGATIVES.items() if code != "en")
#: DuckDB: whether the words ``v`` of a query in language ``lang`` ask a question.
ASKS = f"""(len(v) >= 3 AND list_has_any(CASE lang {_HEADS} ELSE {T.INTERROGATIVES['en']!r} END, [v[1], v[1] || ' ' || v[2]]))"""
_GATE = """(tier = 'T1' OR (tier = 'T2' AND coalesce(verdict, 'unclassified') <> 'unsafe') OR (tier = 'T3' AND verdict = 'safe'))"""
SERVED = f"{S.PAGES}, served AS (SELECT * FROM pages_v JOIN domains USING (host) WHERE NOT suppressed AND status = 'active' AND {_GATE})"
#: Served pages with their zone: the only pages that either arm ever sees.
ZONED = f"{SERVED}, zoned AS (SELECT * FROM (SELECT *, CASE WHEN tier <> 'T1' THEN 'B' WHEN zone_a_eligible THEN 'A' END AS zone FROM served) WHERE zone IS NOT NULL)"
#: All benchmark items ask, by the stems of their words; every vector whose id 50 divides asks under a fiftieth of its id.
ASKED = f"""asked AS (
  SELECT query_id, lang, w, v, list_distinct({stem_sql(f"list_filter(w, lambda x: NOT list_contains({T.STOPS!r}, x))", "lang")}) AS terms
  FROM (SELECT *, {LANG} AS lang FROM (SELECT item_id AS query_id, {WORDS.format('text')} AS v, list_distinct({WORDS.format('text')}) AS w FROM benchmark)))"""
#: Concepts and terms: a term is a benchmark word of five or six letters, its concept the first three.
TERMS = f"""terms AS (
  SELECT substr(term, 1, 3) AS concept, term, CASE WHEN length(term) % 3 = 0 THEN 'fr' ELSE 'en' END AS lang, round(0.5 + length(term) % 6 / 10.0, 2) AS weight
  FROM (SELECT unnest({WORDS.format('text')}) AS term FROM benchmark) WHERE length(term) BETWEEN 5 AND 6 GROUP BY term)"""
EXPANDED = f"""expansion AS (
  SELECT query_id, round(least(weight, 1.0), 1) AS weight, any_value(qlang) AS lang, list(DISTINCT term) AS words
  FROM (SELECT DISTINCT q.query_id, q.lang AS qlang, t2.term, t2.weight FROM asked q, terms t1, terms t2
        WHERE list_contains(q.w, t1.term) AND t1.concept = t2.concept AND t2.lang IN ('en', q.lang) AND t2.term <> t1.term AND NOT list_contains(q.w, t2.term)) GROUP BY 1, 2)"""
LEXICAL = f"""wanted AS (
  SELECT query_id, 0 AS grp, 0.3::DOUBLE AS weight, len(terms) AS n, unnest(terms) AS term FROM asked
  UNION ALL SELECT query_id, CAST(round(weight * 10) AS INT), weight::DOUBLE, len(t), unnest(t) FROM (SELECT *, list_distinct({stem_sql("words", "lang")}) AS t FROM expansion)),
tf AS (
  SELECT page_id, term, 0.2::DOUBLE * count(*) + 1.0::DOUBLE * count(*) FILTER (pos <= n) AS tf
  FROM (SELECT page_id, n, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT page_id, len({WORDS.format('title')}) AS n, {stem_sql(WORDS.format('text'), "lang")} AS w FROM zoned))
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
hits AS (SELECT *, s / n AS density FROM (SELECT query_id, page_id, grp, weight, n, count(*) AS found, sum(tf / (tf + 1.0::DOUBLE)) AS s FROM wanted JOIN tf USING (term) GROUP BY query_id, page_id, grp, weight, n)),
scored AS (
  SELECT query_id, page_id, sum(weight * density + CASE WHEN grp = 0 AND found = n THEN 2.0::DOUBLE + density ELSE 0 END) AS lex_score,
         bool_or(grp = 0 AND found = n) AS strict, max(CASE WHEN grp = 0 THEN found / n ELSE 0 END) AS overlap FROM hits GROUP BY ALL),
lex AS (
  SELECT s.*, zone, row_number() OVER (PARTITION BY query_id, zone ORDER BY round(lex_score, 9) DESC, page_id) AS lex_rank FROM scored s JOIN zoned USING (page_id) QUALIFY lex_rank <= 100)"""
SEMANTIC = """sem AS (
  SELECT query_id, zone, page_id, cosine, row_number() OVER (PARTITION BY query_id, zone ORDER BY round(cosine, 9) DESC, page_id) AS sem_rank
  FROM (SELECT q.vec_id // 50 AS query_id, z.zone, v.vec_id AS page_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS cosine
        FROM embeddings q, embeddings v JOIN zoned z ON z.page_id = v.vec_id WHERE q.vec_id % 50 = 0)
  QUALIFY sem_rank <= 100)"""
FUSED = f"""weights AS (SELECT query_id, CASE WHEN {ASKS} THEN 0.6::DOUBLE ELSE 1.0 END AS lw, CASE WHEN {ASKS} THEN 1.4::DOUBLE ELSE 1.0 END AS sw FROM asked),
fused AS (
  SELECT query_id, zone, page_id, lex_rank, sem_rank, strict, overlap, cosine,
         coalesce(coalesce(lw, 1.0::DOUBLE) / (60 + lex_rank), 0) + coalesce(coalesce(sw, 1.0::DOUBLE) / (60 + sem_rank), 0) AS score
  FROM lex FULL OUTER JOIN sem USING (query_id, zone, page_id) LEFT JOIN weights USING (query_id))"""
LEX = ",\n".join([ZONED, ASKED, TERMS, EXPANDED, LEXICAL])
ARMS = ",\n".join([LEX, SEMANTIC, FUSED])


def zoned(spark: SparkSession, d: str) -> DataFrame:
    """Served pages with their zone."""
    served = gate.servable(S.pages(spark, d), S.domains(spark, d))
    zone = F.when(F.col("tier") != "T1", "B").when(F.col("zone_a_eligible"), "A")
    return served.withColumn("zone", zone).filter(F.col("zone").isNotNull())


def asked(spark: SparkSession, d: str) -> DataFrame:
    """query_id, query, norm, tokens, lang, terms of every benchmark item."""
    items = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), T.normalized(F.col("text")).alias("norm"))
    rows = items.withColumn("lang", T.detect_language(F.col("norm"))).withColumn("tokens", F.array_distinct(T.words(F.col("norm"))))
    return rows.withColumn("terms", T.lexemes(F.col("norm"), F.col("lang")))


def lexicon_terms(spark, d):
    words = S.table(spark, d, "benchmark").select(F.explode(T.words(T.normalized(F.col("text")))).alias("term"))
    words = words.filter(F.length("term").between(5, 6)).distinct()
    return words.select(
        F.substring("term", 1, 3).alias("concept"), "term", F.when(F.length("term") % 3 == 0, "fr").otherwise("en").alias("lang"), F.round(0.5 + F.length("term") % 6 / 10.0, 2).alias("weight")
    )


def expansions(spark: SparkSession, d: str) -> DataFrame:
    """query_id, weight, terms: stems of the lexicon's siblings of each query."""
    queries = asked(spark, d)
    found = lexicon.expand(queries, lexicon_terms(spark, d)).join(queries.select("query_id", "lang"), "query_id")
    return found.select("query_id", "weight", T.stemmed(F.col("terms"), F.col("lang")).alias("terms"))


def lexical(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical(zoned(spark, d), asked(spark, d), expansions(spark, d))


def semantic(spark: SparkSession, d: str) -> DataFrame:
    vectors = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("page_id"), "embedding")
    served = zoned(spark, d).select("page_id", "zone")
    queries = vectors.filter("page_id % 50 = 0").select((F.col("page_id") / 50).cast("bigint").alias("query_id"), "embedding")
    return R.semantic(vectors.join(served, "page_id"), queries)


def weights(spark: SparkSession, d: str) -> DataFrame:
    """query_id, lexical_weight, semantic_weight by the intent of each query."""
    q = asked(spark, d)
    no = F.lit(False)
    kind = T.intent(F.col("norm"), F.col("lang"), no, no, no)  # items are running text: no reference, host or name
    return q.select("query_id", T.fusion_weight(kind, 0).alias("lexical_weight"), T.fusion_weight(kind, 1).alias("semantic_weight"))


def fused(spark: SparkSession, d: str) -> DataFrame:
    return R.fused(lexical(spark, d), semantic(spark, d), weights(spark, d))


def _rank(name: str):
    return F.col(name).cast("bigint").alias(name)


@register("normal_forms", f"""SELECT doc_id, {NORM.format("text")} AS normalized,
  trim(regexp_replace(regexp_replace(translate(lower(trim(text)), '{T.ACCENTED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}\\p{{M}}:.,\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS routable
  FROM documents""")
def normal_forms(spark, d):
    text = F.col("text")
    return S.table(spark, d, "documents").select("doc_id", T.normalized(text).alias("normalized"), T.routable(text).alias("routable"))


@register("lang_detect", f"""SELECT doc_id, {LANG} AS detected FROM (SELECT doc_id, list_distinct({WORDS.format('text')}) AS w FROM documents)""")
def lang_detect(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", T.normalized(F.col("text")).alias("n"))
    return docs.select("doc_id", T.detect_language(F.col("n")).alias("detected"))


@register("query_stems", f"WITH {ASKED} SELECT query_id, lang, array_to_string(list_sort(terms), ' ') AS terms FROM asked")
def query_stems(spark, d):
    return asked(spark, d).select("query_id", "lang", F.array_join(F.array_sort("terms"), " ").alias("terms"))


#: Queries of every kind: user turns, hosts, names of nations, and references to John.
_ROUTED = f"""routed AS (SELECT 'turn ' || query_id AS id, query FROM query_log UNION ALL SELECT 'host ' || host, 'www.' || host FROM domains
  UNION ALL SELECT 'name ' || n_nationkey, lower(n_name) FROM nation UNION ALL SELECT 'verse ' || n_nationkey, 'John ' || (n_nationkey + 1) || ':3' FROM nation)"""


def _routed(spark, d):
    """id, query, norm, routable, lang, intent of queries of every kind."""
    n = S.table(spark, d, "nation")
    text = lambda kind, key, query: (F.concat(F.lit(kind + " "), F.col(key).cast("string")).alias("id"), query.alias("query"))
    rows = S.query_log(spark, d).select(*text("turn", "query_id", F.col("query")))
    rows = rows.unionByName(S.domains(spark, d).select(*text("host", "host", F.concat(F.lit("www."), "host"))))
    rows = rows.unionByName(n.select(*text("name", "n_nationkey", F.lower("n_name"))))
    rows = rows.unionByName(n.select(*text("verse", "n_nationkey", F.concat(F.lit("John "), (F.col("n_nationkey") + 1).cast("string"), F.lit(":3")))))
    rows = rows.withColumn("norm", T.normalized(F.col("query"))).withColumn("routable", T.routable(F.col("query"))).withColumn("lang", T.detect_language(F.col("norm")))
    read = scripture.parsed(rows, "routable")
    hosts = S.domains(spark, d).select(F.col("host").alias("__host"), F.lit(True).alias("is_host"))
    names = n.select(T.normalized(F.col("n_name")).alias("__name"), F.lit(True).alias("is_name"))
    met = read.join(hosts, F.regexp_replace(F.lower(F.trim("query")), "^www\\.", "") == F.col("__host"), "left").join(names, F.col("norm") == F.col("__name"), "left")
    no = F.lit(False)
    return met.withColumn("intent", T.intent(F.col("norm"), F.col("lang"), F.col("ref").isNotNull(), F.coalesce("is_host", no), F.coalesce("is_name", no)))


_INTENTS = f"""{S.QUERY_LOG}, {S.DOMAINS}, {_ROUTED}, r AS (SELECT *, {LANG} AS lang FROM (SELECT id, query, {WORDS.format('query')} AS v, list_distinct({WORDS.format('query')}) AS w FROM routed)),
  intents AS (SELECT id, query, lang, CASE WHEN id LIKE 'verse %' AND CAST(regexp_extract(query, '(\\d+):', 1) AS INT) <= 21 THEN 'scripture'
    WHEN regexp_replace(lower(trim(query)), '^www\\.', '') IN (SELECT host FROM domains) THEN 'navigational'
    WHEN lower(query) IN (SELECT lower(n_name) FROM nation) THEN 'entity' WHEN {ASKS} THEN 'conversational' ELSE 'topical' END AS intent FROM r)"""


@register("intent_route", f"""WITH {_INTENTS} SELECT id, lang, intent, CASE intent WHEN 'conversational' THEN 0.6::DOUBLE WHEN 'navigational' THEN 1.4 ELSE 1.0 END AS lexical_weight,
  CASE intent WHEN 'conversational' THEN 1.4::DOUBLE WHEN 'navigational' THEN 0.6 ELSE 1.0 END AS semantic_weight FROM intents""")
def intent_route(spark, d):
    return _routed(spark, d).select("id", "lang", "intent", T.fusion_weight(F.col("intent"), 0).alias("lexical_weight"), T.fusion_weight(F.col("intent"), 1).alias("semantic_weight"))


@register("volume_by_intent", f"WITH {_INTENTS} SELECT intent, lang, count(*) AS n FROM intents GROUP BY ALL")
def volume_by_intent(spark, d):
    return _routed(spark, d).groupBy("intent", "lang").agg(F.count(F.lit(1)).alias("n"))


@register("query_tokens", f"""WITH {S.QUERY_LOG}, w AS (SELECT query_id, {WORDS.format('query')} AS w FROM query_log)
  SELECT query_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])),
         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])))), '|') AS tokens FROM w""")
def query_tokens(spark, d):
    return S.query_log(spark, d).select("query_id", F.array_join(F.array_sort(T.tokens(T.normalized(F.col("query")))), "|").alias("tokens"))


@register("lexical_topk", f"WITH {LEX} SELECT query_id, zone, page_id, round(lex_score, 9) AS lex_score, strict, lex_rank FROM lex")
def lexical_topk(spark, d):
    return lexical(spark, d).select("query_id", "zone", "page_id", F.round("lex_score", 9).alias("lex_score"), "strict", _rank("lex_rank"))


@register("vector_topk", f"WITH {ZONED}, {SEMANTIC} SELECT query_id, zone, page_id, round(cosine, 6) AS cosine, sem_rank FROM sem")
def vector_topk(spark, d):
    return semantic(spark, d).select("query_id", "zone", "page_id", F.round("cosine", 6).alias("cosine"), _rank("sem_rank"))


@register("hybrid_rrf", f"WITH {ARMS} SELECT query_id, zone, page_id, lex_rank, sem_rank, round(score, 9) AS score FROM fused")
def hybrid_rrf(spark, d):
    return fused(spark, d).select("query_id", "zone", "page_id", _rank("lex_rank"), _rank("sem_rank"), F.round("score", 9).alias("score"))


@register("degraded_search", f"WITH {LEX} SELECT query_id, zone, page_id, lex_rank, round(1.0 / (60 + lex_rank), 9)::DOUBLE AS score FROM lex")
def degraded_search(spark, d):
    """The arms when no query vector can be had."""
    lex = lexical(spark, d)
    return R.fused(lex, R.no_vectors(lex)).select("query_id", "zone", "page_id", _rank("lex_rank"), F.round("score", 9).alias("score"))


_POS = """positioned AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, zone ORDER BY round(score, 12) DESC, page_id) AS pos FROM fused)"""


@register("arm_guarantee", f"""WITH {ARMS}, {_POS}
  SELECT query_id, zone, page_id, pos FROM positioned WHERE pos <= 50 OR lex_rank <= 10 OR sem_rank <= 10""")
def arm_guarantee(spark, d):
    return R.positioned(fused(spark, d), 50).select("query_id", "zone", "page_id", _rank("pos"))


def _hosted(spark, d, zone: str):
    pages = S.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("host"))
    return R.positioned(fused(spark, d).filter(F.col("zone") == zone), 200, 0).join(pages, "page_id")


_HOSTED = f"""{ARMS}, {_POS}, hosted AS (
  SELECT p.*, d.source AS host FROM positioned p JOIN documents d ON d.doc_id = p.page_id WHERE pos <= 200)"""


@register("host_cap", f"""WITH {_HOSTED}
  SELECT query_id, page_id, host, pos FROM hosted WHERE zone = 'B' QUALIFY row_number() OVER (PARTITION BY query_id, host ORDER BY pos) <= 2""")
def host_cap(spark, d):
    return R.host_capped(_hosted(spark, d, "B"), 2).select("query_id", "page_id", "host", _rank("pos"))


@register("zone_a_assemble", f"""WITH {_HOSTED}, hit AS (SELECT DISTINCT query_id, true AS lexicon_hit FROM expansion WHERE weight >= 0.9),
  crossed AS (SELECT h.* FROM (SELECT *, max(overlap) OVER (PARTITION BY query_id) AS known FROM hosted WHERE zone = 'A') h LEFT JOIN hit USING (query_id)
    WHERE known IS NULL OR coalesce(lexicon_hit, false) OR coalesce(overlap >= 0.05, false)),
  gated AS (SELECT * FROM crossed QUALIFY max(CASE WHEN pos <= 5 AND (coalesce(cosine >= 0.68, false) OR coalesce(strict, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) = 1),
  capped AS (SELECT * FROM gated QUALIFY row_number() OVER (PARTITION BY query_id, host ORDER BY pos) <= 3),
  placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place, first_value(score) OVER (PARTITION BY query_id ORDER BY pos) AS top FROM capped)
  SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY host = 'src9' DESC, place) AS position,
         CASE WHEN top >= 0.028603 THEN 'strong' WHEN top >= 0.018560 THEN 'moderate' WHEN top >= 0.011027 THEN 'weak' ELSE 'none' END AS coverage
  FROM placed WHERE place <= CASE WHEN top >= 0.028603 THEN 5 WHEN top >= 0.018560 THEN 3 WHEN top >= 0.011027 THEN 2 ELSE 0 END""")
def zone_a_assemble(spark, d):
    """Zone A; the share of a query's stems on a page stands in for the cross-encoder, siblings of weight 0.9 or more for a lexicon hit."""
    hits = expansions(spark, d).filter("weight >= 0.9").select("query_id").distinct().withColumn("lexicon_hit", F.lit(True))
    rows = _hosted(spark, d, "A").withColumn("rerank_score", F.col("overlap")).join(hits, "query_id", "left")
    return R.zone_a_block(rows, "src9", cross_floor=R.CROSS_FLOOR, lexicon_hit="lexicon_hit").select("query_id", "page_id", _rank("position"), "coverage")


_ZONE_B = f"""{_HOSTED}, capped_b AS (SELECT * FROM hosted WHERE zone = 'B' QUALIFY row_number() OVER (PARTITION BY query_id, host ORDER BY pos) <= 2),
  paged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 10 AS position FROM capped_b QUALIFY position BETWEEN 1 AND 10)"""


@register("zone_b_page", f"WITH {_ZONE_B} SELECT query_id, page_id, position FROM paged")
def zone_b_page(spark, d):
    return R.zone_b_page(_hosted(spark, d, "B"), 2).select("query_id", "page_id", _rank("position"))


def snippet_sql(text: str, limit: int) -> str:
    """DuckDB: ``functions.text.snippet``."""
    head = f"substr({text}, 1, {limit})"
    sentence = f"regexp_extract({head}, '(?s)^(.*[.!?])(?:\\s.*)?$', 1)"
    return f"CASE WHEN length({text}) <= {limit} THEN {text} WHEN {sentence} <> '' THEN {sentence} ELSE regexp_replace({head}, '\\s+\\S*$', '') || '…' END"


@register("result_payload", f"""WITH {_ZONE_B} SELECT query_id, p.zone, position, 'https://' || z.host || '/' || p.page_id AS url, z.host, title, {snippet_sql('text', 240)} AS snippet, round(score, 6) AS score
  FROM paged p JOIN zoned z USING (page_id)""")
def result_payload(spark, d):
    shown = R.zone_b_page(_hosted(spark, d, "B"), 2)
    return R.payload(shown, zoned(spark, d)).withColumn("position", F.col("position").cast("bigint"))



@register("boosts", f"""WITH {S.PAGES}
  SELECT page_id, round((1.0/61) * (1 + 0.25 * 0.3 * 0.5) * (1 + 0.2 * CASE WHEN lang = 'en' THEN 1 ELSE 0 END) * (1 + 0.08 * exp(-greatest(datediff('day', first_seen, DATE '2025-06-01'), 0) / 365.0))
    * (1 + 0.15 * least(n_chars / 50.0, 100) / 100) * (1 + 0.2 * (page_id % 100) / 100), 9) AS zone_a,
   round((1.0/61) * (1 + 0.25 * 0.3 * 0.5) * (1 + 0.2 * CASE WHEN lang = 'en' THEN 1 ELSE 0 END) * (1 + 0.08 * exp(-greatest(datediff('day', first_seen, DATE '2025-06-01'), 0) / 365.0))
    * (1 + 0.1 * CASE WHEN tier = 'T2' THEN 1 ELSE 0 END) * (1 + 0.05 * CASE WHEN verdict = 'safe' THEN 100 ELSE 0 END / 100), 9) AS zone_b
  FROM pages_v JOIN domains USING (host)""")
def boosts(spark, d):
    p = S.pages(spark, d).join(S.domains(spark, d), "host")
    common = {"ctr": 0.3, "confidence": 0.5, "lang": (F.col("lang") == "en").cast("int"), "fresh": R.freshness(F.col("first_seen"), F.lit("2025-06-01").cast("date"))}
    base = F.lit(1.0 / 61)
    a = R.boosted(base, "A", quality=F.least(F.col("n_chars") / 50.0, F.lit(100.0)), engagement=F.col("page_id") % 100, **common)
    b = R.boosted(base, "B", tier2=(F.col("tier") == "T2").cast("int"), safety=F.when(F.col("verdict") == "safe", 100).otherwise(0), **common)
    return p.select("page_id", F.round(a, 9).alias("zone_a"), F.round(b, 9).alias("zone_b"))


@register("zone_gate", f"""WITH {SERVED} SELECT page_id, host, tier, CASE WHEN tier = 'T1' THEN CASE WHEN zone_a_eligible THEN 'A' END ELSE 'B' END AS zone FROM served""")
def zone_gate(spark, d):
    zone = F.when(F.col("tier") == "T1", F.when(F.col("zone_a_eligible"), "A")).otherwise("B")
    return gate.servable(S.pages(spark, d), S.domains(spark, d)).select("page_id", "host", "tier", zone.alias("zone"))


@register("why_not_served", f"""WITH {S.PAGES} SELECT page_id, CASE WHEN suppressed THEN 'suppressed' WHEN status <> 'active' THEN 'domain is not active'
  WHEN tier = 'T0' THEN 'domain is in quarantine' WHEN tier = 'T2' AND coalesce(verdict, '') = 'unsafe' THEN 'judged unsafe'
  WHEN tier = 'T3' AND coalesce(verdict, '') <> 'safe' THEN 'not judged safe' END AS reason FROM pages_v LEFT JOIN domains USING (host)""")
def why_not_served(spark, d):
    return gate.why_not(S.pages(spark, d), S.domains(spark, d)).select("page_id", "reason")


@register("invariants", f"""WITH {SERVED} SELECT 'quarantined page served' AS rule, count(*) FILTER (tier = 'T0') AS broken FROM served
  UNION ALL SELECT 'unsafe open-web page served', count(*) FILTER (tier = 'T3' AND coalesce(verdict, '') <> 'safe') FROM served
  UNION ALL SELECT 'unsafe approved page served', count(*) FILTER (tier = 'T2' AND coalesce(verdict, '') = 'unsafe') FROM served
  UNION ALL SELECT 'suppressed page served', count(*) FILTER (suppressed) FROM served""")
def invariants(spark, d):
    return gate.violations(S.pages(spark, d), S.domains(spark, d))


@register("facet_filter", f"""WITH {SERVED} SELECT page_id FROM served WHERE lang = 'fr' AND tier IN ('T2', 'T3') AND host = 'src10'""")
def facet_filter(spark, d):
    rows = gate.servable(S.pages(spark, d), S.domains(spark, d))
    for column, wanted in {"lang": ["fr"], "tier": ["T2", "T3"], "host": ["src10"], "category": None}.items():
        if wanted:  # each predicate only when asked for
            rows = rows.filter(F.col(column).isin(wanted))
    return rows.select("page_id")


@register("lexicon_expand", f"""WITH {TERMS}, q AS (SELECT item_id AS query_id, list_distinct({WORDS.format('text')}) AS w FROM benchmark),
  hit AS (SELECT DISTINCT q.query_id, t2.term, t2.weight FROM q, terms t1, terms t2
          WHERE list_contains(q.w, t1.term) AND t1.concept = t2.concept AND t2.lang IN ('en', 'fr') AND t2.term <> t1.term AND NOT list_contains(q.w, t2.term))
  SELECT query_id, round(least(weight, 1.0), 1) AS weight, array_to_string(list_sort(list(DISTINCT term)), ' ') AS terms FROM hit GROUP BY 1, 2""")
def lexicon_expand(spark, d):
    queries = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(T.words(T.normalized(F.col("text")))).alias("tokens"), F.lit("fr").alias("lang"))
    found = lexicon.expand(queries, lexicon_terms(spark, d))
    return found.select("query_id", "weight", F.array_join("terms", " ").alias("terms"))


def _trigrams_sql(text: str) -> str:
    words = WORDS.format(text)
    return f"list_distinct(flatten(list_transform({words}, lambda x: list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i, 3)))))"


@register("trigram_similarity", f"""WITH a AS (SELECT item_id, {_trigrams_sql("split_part(text, chr(10), 1)")} AS x FROM benchmark), b AS (SELECT doc_id, {_trigrams_sql("split_part(text, chr(10), 1)")} AS y FROM documents)
  SELECT item_id, doc_id, round(s / (len(x) + len(y) - s), 6) AS similarity FROM (SELECT *, len(list_intersect(x, y)) AS s FROM a, b) WHERE s > 0 AND round(s / (len(x) + len(y) - s), 6) >= 0.3""")
def trigram_similarity(spark, d):
    """Benchmark items against every document, both by their first lines, at pg_trgm's usual threshold, by shared trigrams."""
    line = F.substring_index("text", "\n", 1)
    items = S.table(spark, d, "benchmark").select("item_id", line.alias("a"))
    titles = S.table(spark, d, "documents").select("doc_id", line.alias("b"))
    return lexicon.similar(items, "item_id", "a", titles, "doc_id", "b", 0.3)


@register("suggest", f"""WITH {TERMS}, q AS (SELECT DISTINCT substr({WORDS.format('text')}[1], 1, 2) AS prefix FROM benchmark),
  a AS (SELECT prefix, term AS suggestion, weight * 2 AS w FROM q JOIN terms ON starts_with(term, prefix) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY weight DESC, term) <= 6),
  b AS (SELECT prefix, source AS suggestion, 1.0 AS w FROM q JOIN (SELECT DISTINCT source FROM documents) ON starts_with(source, prefix) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY source) <= 3),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
  top AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY w DESC, length(suggestion), suggestion) AS n FROM u QUALIFY n <= 10)
  SELECT prefix, lower(suggestion) AS suggestion, min(n) AS place FROM top GROUP BY 1, 2""")
def suggest(spark, d):
    prefix = S.table(spark, d, "benchmark").select(F.substring(T.words(T.normalized(F.col("text")))[0], 1, 2).alias("prefix")).distinct()
    hosts = S.table(spark, d, "documents").select(F.col("source").alias("suggestion")).distinct().withColumn("w", F.lit(1.0))
    terms = lexicon_terms(spark, d).select(F.col("term").alias("suggestion"), (F.col("weight") * 2).alias("w"))
    return lexicon.suggest(prefix, [(terms, 6), (hosts, 3)]).select("prefix", "suggestion", F.col("place").cast("bigint").alias("place"))


@register("best_bets", f"""WITH {S.QUERY_LOG}, q AS (SELECT query_id, {NORM.format('query')} AS n FROM query_log)
  SELECT query_id, bet_id FROM (SELECT query_id, bet_id, row_number() OVER (PARTITION BY query_id ORDER BY position, bet_id) AS k
    FROM q JOIN (VALUES (1, 'exact', 'the', 1), (2, 'contains', 'and', 2), (3, 'regex', '^that .*', 1), (4, 'contains', 'ing', 3)) b(bet_id, kind, pattern, position)
      ON (kind = 'exact' AND n = pattern) OR (kind = 'contains' AND contains(n, pattern)) OR (kind = 'regex' AND regexp_matches(n, pattern))) WHERE k <= 2""")
def best_bets(spark, d):
    rows = [(1, "exact", "the", 1), (2, "contains", "and", 2), (3, "regex", "^that .*", 1), (4, "contains", "ing", 3)]
    bets = spark.createDataFrame(rows, "bet_id int, kind string, pattern string, position int")
    queries = S.query_log(spark, d).select("query_id", T.normalized(F.col("query")).alias("normalized"))
    return lexicon.best_bets(queries, lexicon.valid_patterns(bets)).select("query_id", "bet_id")


@register("thread_links", f"""WITH {SERVED}, e AS (SELECT DISTINCT page_id, page_id % 100 AS engagement, unnest(string_split(title, ' ')) AS tag FROM served WHERE tier = 'T1'),
  p AS (SELECT DISTINCT a.page_id AS seed, b.page_id, b.engagement FROM e a JOIN e b USING (tag) WHERE tag <> '' AND a.page_id <> b.page_id)
  SELECT seed, page_id, CAST(row_number() OVER (PARTITION BY seed ORDER BY engagement DESC, page_id) AS INT) AS place FROM p QUALIFY place <= 3""")
def thread_links(spark, d):
    """Up to three served pages of the first tier that share a word of the first line with a seed, by engagement."""
    pages = gate.servable(S.pages(spark, d), S.domains(spark, d)).filter("tier = 'T1'")
    rows = pages.select("page_id", F.array_distinct(F.split("title", " ")).alias("tags"), (-(F.col("page_id") % 100)).alias("engagement"))
    return lexicon.first_overlapping(rows, "page_id", "tags", [F.col("engagement")], most=3)


@register("navigational", f"""WITH {S.DOMAINS}, c AS (SELECT source AS host, count(*) AS n FROM documents GROUP BY 1),
  q AS (SELECT unnest(['src1', 'src12', 'www.src3', 'nothing']) AS query)
  SELECT query, host, tier FROM (SELECT q.query, d.host, d.tier, row_number() OVER (PARTITION BY q.query ORDER BY d.tier, c.n DESC, d.host) AS k
    FROM q JOIN domains d ON d.host = regexp_replace(q.query, '^www\\.', '') JOIN c USING (host)) WHERE k = 1""")
def navigational(spark, d):
    queries = spark.createDataFrame([("src1",), ("src12",), ("www.src3",), ("nothing",)], "query string")
    counts = S.table(spark, d, "documents").groupBy(F.col("source").alias("host")).agg(F.count(F.lit(1)).alias("n"))
    rows = queries.withColumn("host", F.regexp_replace("query", "^www\\.", "")).join(S.domains(spark, d), "host").join(counts, "host")
    w = Window.partitionBy("query").orderBy("tier", F.col("n").desc(), "host")
    return rows.withColumn("k", F.row_number().over(w)).filter("k = 1").select("query", "host", "tier")


@register("cover_density", None)
def cover_density(spark, d):
    pages = zoned(spark, d).select("page_id", "text")
    queries = asked(spark, d).select("query_id", F.array_except("tokens", F.array(*map(F.lit, T.STOPS))).alias("terms"))
    top = lexical(spark, d).filter("lex_rank <= 20")
    return R.cover_ranked(R.postings(pages.join(R.small(top.select("page_id").distinct()), "page_id", "left_semi")), queries, top)


@register("phrase_match", f"""SELECT doc_id AS page_id FROM documents WHERE contains(' ' || {NORM.format('text')} || ' ', ' of the ')""")
def phrase_match(spark, d):
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return R.phrase(R.postings(docs), ["of", "the"])


def _best_chunks(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``rows`` (query_id, page_id, query, ...) plus heading and chunk: the chunk of the page with most of the query's words, of equals the first.

    Each page is cut once, however many queries ask for it; a page without chunks stands as its text.
    """
    held = pages.join(rows.select("page_id").distinct(), "page_id", "left_semi")
    cut = A.chunked(held).select("page_id", "ordinal", F.col("heading_path").alias("heading"), F.col("text").alias("chunk"))
    whole = held.join(cut.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("chunk"))
    parts = cut.unionByName(whole).withColumn("__have", F.array_distinct(F.split(F.lower("chunk"), "\\s+")))
    want = F.array_distinct(F.split(F.lower("query"), "\\s+"))
    met = rows.join(parts, "page_id").withColumn("__shared", F.size(F.array_intersect(want, "__have")))
    best = F.max_by(F.struct("heading", "chunk"), F.struct(F.col("__shared"), -F.col("ordinal"))).alias("__best")
    return met.groupBy(*rows.columns).agg(best).select(*rows.columns, "__best.heading", "__best.chunk")


@register("rerank_stub", None)
def rerank_stub(spark, d):
    queries = asked(spark, d).select("query_id", "query")
    pages = zoned(spark, d).select("page_id", "text", "title")
    rows = R.positioned(fused(spark, d).filter("zone = 'B'"), 50, 0).select("query_id", "page_id", "pos").join(queries, "query_id")
    rows = _best_chunks(rows, pages.select("page_id", "text")).join(pages.select("page_id", "title"), "page_id")
    body = R.rerank_text(F.col("title"), F.lit(None), F.col("heading"), F.col("chunk"))
    rows = rows.select("query_id", "page_id", "pos", "query", body.alias("body"))
    return R.reranked(rows, R.overlap_scorer).select("query_id", "page_id", "pos", F.round("rerank_score", 6).alias("rerank_score"), "reranked", "degraded")


@register("headline", None)
def headline(spark, d):
    top = lexical(spark, d).filter("lex_rank <= 3").join(asked(spark, d).select("query_id", "tokens"), "query_id")
    body = zoned(spark, d).select("page_id", "text")

    def mark(batches):
        for batch in batches:
            batch["headline"] = [R.headline(t, list(q)) for t, q in zip(batch["text"], batch["tokens"])]
            yield batch[["query_id", "page_id", "headline"]]

    return top.join(body, "page_id").select("query_id", "page_id", "tokens", "text").mapInPandas(mark, "query_id bigint, page_id bigint, headline string")


#: One query for each nation: the k-th book by name, chapter 3k + 1, verse 2.
_REFS = [entry.strip().rsplit(" ", 1) for entry in scripture.BOOKS.replace("\n", " ").split(",")]


@register("scripture_refs", f"""WITH b AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{name}', {n})" for k, (name, n) in enumerate(_REFS))}) b(k, book, chapters))
  SELECT n_nationkey AS id, CASE WHEN n_nationkey * 3 + 1 <= chapters THEN book || ' ' || (n_nationkey * 3 + 1) || ':2' END AS ref FROM nation JOIN b ON k = n_nationkey""")
def scripture_refs(spark, d):
    named = spark.createDataFrame([(k, name.title()) for k, (name, _) in enumerate(_REFS)], "k int, book string")
    queries = S.table(spark, d, "nation").join(named, F.col("k") == F.col("n_nationkey"))
    queries = queries.select(F.col("n_nationkey").alias("id"), F.concat("book", F.lit(" "), (F.col("n_nationkey") * 3 + 1).cast("string"), F.lit(":2")).alias("q"))
    return scripture.parsed(queries, "q").select("id", "ref")


@register("scripture_cards", """SELECT n_nationkey AS id, 'john ' || (n_nationkey + 1) || ':3' AS ref, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS card FROM nation WHERE n_nationkey < 21""")
def scripture_cards(spark, d):
    """Cards of the references to John that are sound; a passage that is not there gives no card."""
    n = S.table(spark, d, "nation")
    ref = F.concat(F.lit("john "), (F.col("n_nationkey") + 1).cast("string"), F.lit(":3"))
    found = scripture.parsed(n.select(F.col("n_nationkey").alias("id"), ref.alias("q")), "q").filter("ref IS NOT NULL")
    return scripture.cards(found, n.filter("n_nationkey % 2 = 0").select(ref.alias("ref"), F.col("n_name").alias("text"))).select("id", "ref", "card")
