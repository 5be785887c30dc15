"""Lexical and vector candidates for many queries at once, fusion, boosts and zone assembly.

All operators work on a whole batch of queries: ``queries`` has ``query_id`` and what the
arm needs, results are keyed by ``query_id``.  Ties go to the smaller page id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.shared import written

#: Reciprocal rank constant, arm weights and boosts (fixed values).
K = 60
ANY_WEIGHT = 0.30
BOOST = {"quality": 0.15, "engage": 0.20, "ctr": 0.25, "lang": 0.20, "fresh": 0.08, "tier2": 0.10, "safety": 0.05}
#: Zone sizing (fixed values): (least score, size, coverage).
SIZES = [(0.028603, 5, "strong"), (0.018560, 3, "moderate"), (0.011027, 2, "weak")]
MAX_PER_HOST_A, MAX_PER_HOST_B, PAGE_B = 3, 2, 10
COSINE_FLOOR = 0.68
#: Score below which the cross-encoder gate drops a row; -1 turns it off.
CROSS_FLOOR = 0.05
#: Weights of a word in the body and, on top of it, in the title (fixed values).
BODY, TITLE = 0.2, 1.0
#: Query vectors that go out at a time, and rows that a broadcast may hold; larger sets are dealt in blocks or joined by shuffle.
BROADCAST_QUERIES, BROADCAST_ROWS = 10_000, 500_000


def postings(pages: DataFrame, body: str = "text") -> DataFrame:
    """page_id, term, pos (from 0): the inverted table.  Written sorted by term it prunes by row group."""
    return pages.select("page_id", F.posexplode(T.words(T.normalized(F.col(body)))).alias("pos", "term"))


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` marked for broadcast if they are at most ``most``, counted; else as they are, for a join by shuffle."""
    return F.broadcast(rows) if len(rows.limit(most + 1).select(F.lit(1)).collect()) <= most else rows


def weighed_counts(pages: DataFrame, wanted: DataFrame, body: str = "text") -> DataFrame:
    """page_id, term, tf: weight of each ``wanted`` stem on each page, title words weighing ``TITLE`` more than ``BODY``.

    ``pages``: page_id, title, lang, body.  Words are stemmed by the page's dictionary and met with the terms that were asked for
    before anything is counted or shuffled, so frequent words that nobody asks for cost no row.
    """
    words = T.stemmed(T.words(T.normalized(F.col(body))), F.col("lang"))
    n_title = F.size(T.words(T.normalized(F.col("title"))))
    # In two steps: beside a generator the title would be split again for every word.
    held = pages.select("page_id", n_title.alias("__n"), words.alias("__w"))
    spread = held.select("page_id", "__n", F.posexplode("__w").alias("__pos", "term"))
    met = spread.join(small(wanted.select("term").distinct()), "term")
    weight = BODY * F.count(F.lit(1)) + TITLE * F.count_if(F.col("__pos") < F.col("__n"))
    return met.groupBy("page_id", "term").agg(weight.alias("tf"))


def asked_groups(queries: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """query_id, grp, weight, n, term: the query's own stems as group 0, each weight of its expansions as another."""
    own = queries.select("query_id", F.lit(0).alias("grp"), F.lit(ANY_WEIGHT).alias("weight"), F.array_distinct("terms").alias("terms"))
    if expansions is not None:
        more = expansions.select("query_id", F.round(F.col("weight") * 10).cast("int").alias("grp"), F.col("weight").cast("double").alias("weight"), F.array_distinct("terms").alias("terms"))
        own = own.unionByName(more)
    return own.select("query_id", "grp", "weight", F.size("terms").alias("n"), F.explode("terms").alias("term"))


def lexical(pages: DataFrame, queries: DataFrame, expansions: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """query_id, zone, page_id, lex_score, strict, overlap, lex_rank: the best ``limit`` pages of each query and zone.

    ``pages``: page_id, zone, title, lang, text, only what may be served; ``queries``: query_id, terms (stems).  The density of a
    group of stems on a page is the mean of tf / (tf + 1) over the group.  A page with every stem of the query scores 2 and its density, on top of
    ``ANY_WEIGHT`` of the density that any page has, and the densities of expansions by their weights: a full match stays ahead.
    """
    wanted = written(asked_groups(queries, expansions), "asked")
    counts = weighed_counts(pages, wanted)
    hits = counts.join(small(wanted), "term").groupBy("query_id", "page_id", "grp", "weight", "n").agg(
        F.count(F.lit(1)).alias("found"), (F.sum(F.col("tf") / (F.col("tf") + 1.0)) / F.col("n")).alias("density")
    )
    own = F.col("grp") == 0
    full = own & (F.col("found") == F.col("n"))
    score = F.col("weight") * F.col("density") + F.when(full, 2.0 + F.col("density")).otherwise(0.0)
    scored = hits.groupBy("query_id", "page_id").agg(
        F.sum(score).alias("lex_score"), F.max(full).alias("strict"), F.max(F.when(own, F.col("found") / F.col("n")).otherwise(0.0)).alias("overlap")
    )
    order = Window.partitionBy("query_id", "zone").orderBy(F.round("lex_score", 9).desc(), "page_id")
    placed = scored.join(pages.select("page_id", "zone"), "page_id").withColumn("lex_rank", F.row_number().over(order))
    return placed.filter(F.col("lex_rank") <= limit).select("query_id", "zone", "page_id", "lex_score", "strict", "overlap", "lex_rank")


def phrase(post: DataFrame, terms: list[str]) -> DataFrame:
    """page_id of pages in which ``terms`` follow one another."""
    found = post.filter(F.col("term") == terms[0]).select("page_id", F.col("pos").alias("at"))
    for k, term in enumerate(terms[1:], 1):
        step = post.filter(F.col("term") == term).select("page_id", (F.col("pos") - k).alias("at"))
        found = found.join(step, ["page_id", "at"], "left_semi")
    return found.select("page_id").distinct()


def cover_density(positions: list[list[int]], length: int) -> float:
    """Cover-density rank of one document: minimal covers of all terms, shorter ones weigh more; log length and r / (r + 1) damping."""
    if not positions or any(not p for p in positions):
        return 0.0
    events = sorted((p, t) for t, places in enumerate(positions) for p in places)
    last, rank, before = [-1] * len(positions), 0.0, -1
    for place, term in events:
        last[term] = place
        start = min(last)
        if start > before:
            noise = place - start - (len(positions) - 1)
            rank += 0.1 * len(positions) / (len(positions) + max(noise, 0))
            before = start
    rank /= 1 + np.log(max(length, 1))
    return float(rank / (rank + 1))


def cover_ranked(post: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, page_id, cover: cover-density rank of candidate rows only."""
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    length = post.join(candidates.select("page_id").distinct(), "page_id", "left_semi").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    places = (
        candidates.select("query_id", "page_id")
        .join(wanted, "query_id")
        .join(post, ["page_id", "term"], "left")
        .groupBy("query_id", "page_id", "term")
        .agg(F.sort_array(F.collect_list("pos")).alias("places"))
        .groupBy("query_id", "page_id")
        .agg(F.collect_list("places").alias("places"))
        .join(length, "page_id")
    )

    @F.pandas_udf("double")
    def rank(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([cover_density([list(x) for x in a], int(b)) for a, b in zip(p, n)])

    return places.select("query_id", "page_id", rank("places", "n").alias("cover"))


def headline(body: str, terms: list[str], least: int = 12, most: int = 32) -> str:
    """The window of ``least`` to ``most`` words with most query terms, terms marked; windows are compared by running counts."""
    parts = body.split()
    want = {t.lower() for t in terms}
    hit = [w.strip(".,;:!?").lower() in want for w in parts]
    total = np.cumsum([0, *hit])
    best = int(np.argmax(total[most:] - total[: len(total) - most])) if len(parts) > most else 0
    shown = range(best, min(len(parts), best + max(least, most)))
    return " ".join(f"<mark>{parts[i]}</mark>" if hit[i] else parts[i] for i in shown)


def unit(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / norm)


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def semantic(vectors: DataFrame, queries: DataFrame, limit: int = 100) -> DataFrame:
    """query_id, zone, page_id, cosine, sem_rank: best ``limit`` of each query and zone, exactly.

    ``vectors``: page_id, zone, embedding, only what may be served; a page's best chunk counts.  A block of queries
    meets every partition of vectors as a matrix; a partition keeps the best ``limit`` a query and zone as it goes and
    gives them out once, and only those are ranked overall.  Queries go out in blocks of ``BROADCAST_QUERIES`` at most.
    """
    blocks = max(1, -(-2 * queries.count() // BROADCAST_QUERIES))
    found = None
    for k in range(blocks):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        one = _nearest(vectors, some, limit)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id", "zone").orderBy(F.round("cosine", 9).desc(), "page_id")
    best = found.groupBy("query_id", "zone", "page_id").agg(F.max("cosine").alias("cosine"))
    return best.withColumn("sem_rank", F.row_number().over(order)).filter(F.col("sem_rank") <= limit)


def _nearest(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    held = queries.select("query_id", "embedding").limit(BROADCAST_QUERIES + 1).collect()
    if len(held) > BROADCAST_QUERIES:
        raise ValueError("a block of queries is too large")
    ids = np.array([r["query_id"] for r in held], np.int64)
    asked = np.array([r["embedding"] for r in held], np.float64).reshape(len(held), -1)
    asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-12)

    def best(batches):
        kept: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            column = batch.column(2)
            m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            zones = np.array(batch.column(1).to_pylist(), object)
            for zone in set(zones.tolist()):
                at = np.flatnonzero(zones == zone)
                pages = batch.column(0).to_numpy()[at]
                order = np.argsort(pages, kind="stable")
                pages, starts = np.unique(pages[order], return_index=True)
                held = kept.setdefault(zone, [])
                for lo in range(0, len(ids), 256):
                    near = np.maximum.reduceat((asked[lo : lo + 256] @ m[at].T)[:, order], starts, axis=1)
                    held.append(_top(np.repeat(np.arange(lo, lo + len(near)), len(pages)), np.tile(pages, len(near)), near.ravel(), limit))
                if sum(len(h[0]) for h in held) > 4 * limit * len(ids):
                    kept[zone] = [_top(*(np.concatenate(c) for c in zip(*held)), limit)]
        for zone, held in kept.items():
            q, pages, near = _top(*(np.concatenate(c) for c in zip(*held)), limit)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array([zone] * len(q), pa.string()), pa.array(pages), pa.array(near)], ["query_id", "zone", "page_id", "cosine"])

    return vectors.select(F.col("page_id").cast("bigint"), "zone", "embedding").mapInArrow(best, "query_id bigint, zone string, page_id bigint, cosine double")


def _top(query: np.ndarray, page: np.ndarray, near: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``limit`` distinct pages of each query."""
    order = np.lexsort((page, -np.round(near, 9), query))
    query, page, near = query[order], page[order], near[order]
    _, first = np.unique(np.stack([query, page]), axis=1, return_index=True)
    first.sort()
    query, page, near = query[first], page[first], near[first]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < limit
    return query[keep], page[keep], near[keep]


def no_vectors(lex: DataFrame) -> DataFrame:
    """An empty semantic arm, for when no query vector can be had: the lexical arm then stands alone."""
    return lex.sparkSession.createDataFrame([], "query_id bigint, zone string, page_id bigint, cosine double, sem_rank int")


def fused(lex: DataFrame, sem: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """query_id, zone, page_id, lex_rank, sem_rank, strict, overlap, cosine, score: weighted reciprocal rank fusion over both arms.

    ``weights``: query_id, lexical_weight, semantic_weight; a query without weighs both as 1.
    """
    joined = lex.select("query_id", "zone", "page_id", "lex_rank", "strict", "overlap").join(sem, ["query_id", "zone", "page_id"], "full")
    if weights is not None:
        joined = joined.join(small(weights), "query_id", "left")
    weight = lambda c: F.coalesce(F.col(c), F.lit(1.0)) if weights is not None else F.lit(1.0)
    part = lambda w, rank: F.coalesce(weight(w) / (K + F.col(rank)), F.lit(0.0))
    scored = joined.withColumn("score", part("lexical_weight", "lex_rank") + part("semantic_weight", "sem_rank"))
    return scored.drop("lexical_weight", "semantic_weight")


def positioned(rows: DataFrame, limit: int, guarantee: int = 10) -> DataFrame:
    """``rows`` plus pos within query and zone, keeping the best ``limit`` and each arm's best ``guarantee``."""
    order = Window.partitionBy("query_id", "zone").orderBy(F.round("score", 12).desc(), "page_id")
    keep = (F.col("pos") <= limit) | (F.col("lex_rank") <= guarantee) | (F.col("sem_rank") <= guarantee)
    return rows.withColumn("pos", F.row_number().over(order)).filter(F.coalesce(keep, F.lit(False)))


def freshness(published: Column, as_of: Column, days: float = 365.0) -> Column:
    return F.exp(-F.greatest(F.datediff(as_of, published), F.lit(0)) / F.lit(days))


def boosted(score: Column, zone: str, *, quality=0.0, engagement=0.0, ctr=0.0, confidence=0.0, lang=0.0, fresh=0.0, tier2=0.0, safety=0.0) -> Column:
    """Fusion score times the boosts of a zone; arguments are columns or numbers."""
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    both = (1 + BOOST["ctr"] * c(ctr) * c(confidence)) * (1 + BOOST["lang"] * c(lang)) * (1 + BOOST["fresh"] * c(fresh))
    if zone == "A":
        return score * both * (1 + BOOST["quality"] * c(quality) / 100) * (1 + BOOST["engage"] * c(engagement) / 100)
    return score * both * (1 + BOOST["tier2"] * c(tier2)) * (1 + BOOST["safety"] * c(safety) / 100)


def host_capped(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of a host per query, order kept by ``pos``."""
    w = Window.partitionBy("query_id", "host").orderBy("pos")
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def zone_size(top: Column) -> Column:
    """How many results a best score earns."""
    out = F.when(top.isNull(), 0)
    for least, size, _ in SIZES:
        out = out.when(top >= least, size)
    return out.otherwise(0)


def coverage(top: Column) -> Column:
    out = F.when(top.isNull(), "none")
    for least, _, name in SIZES:
        out = out.when(top >= least, name)
    return out.otherwise("none")


def vector_gated(rows: DataFrame, floor: float = COSINE_FLOOR) -> DataFrame:
    """Rows of queries of whose five best one is near enough or matches strictly."""
    best = Window.partitionBy("query_id")
    ok = F.max(F.coalesce((F.col("pos") <= 5) & ((F.col("cosine") >= floor) | F.col("strict")), F.lit(False))).over(best)
    return rows.withColumn("__ok", ok).filter("__ok").drop("__ok")


def cross_gated(rows: DataFrame, floor: float = CROSS_FLOOR, lexicon_hit: str | None = None) -> DataFrame:
    """Rows whose ``rerank_score`` reaches ``floor``; it stands down for queries with a lexicon hit, for those without scores, and at -1."""
    if floor == -1:
        return rows
    scored = F.max(F.col("rerank_score").isNotNull()).over(Window.partitionBy("query_id"))
    free = ~F.col("__scored") | (F.coalesce(F.col(lexicon_hit), F.lit(False)) if lexicon_hit else F.lit(False))
    return rows.withColumn("__scored", scored).filter(free | F.coalesce(F.col("rerank_score") >= floor, F.lit(False))).drop("__scored")


def zone_a_block(rows: DataFrame, prefer_host: str | None = None, floor: float = COSINE_FLOOR, cross_floor: float = -1, lexicon_hit: str | None = None) -> DataFrame:
    """Zone A: cross-encoder gate, vector gate, host cap, size by the best score, preferred site first, positions."""
    capped = host_capped(vector_gated(cross_gated(rows, cross_floor, lexicon_hit), floor), MAX_PER_HOST_A)
    by_pos = Window.partitionBy("query_id").orderBy("pos")
    sized = capped.withColumn("place", F.row_number().over(by_pos)).withColumn("top", F.first("score").over(by_pos))
    shown = sized.filter(F.col("place") <= zone_size(F.col("top")))
    local = (F.col("host") == prefer_host) | F.col("host").endswith(f".{prefer_host}") if prefer_host else F.lit(False)
    order = Window.partitionBy("query_id").orderBy(local.desc(), "place")
    return shown.withColumn("position", F.row_number().over(order)).withColumn("coverage", coverage(F.col("top"))).drop("place", "top")


def zone_b_page(rows: DataFrame, page: int = 1) -> DataFrame:
    """Zone B: host cap, one page of results, positions from 1."""
    capped = host_capped(rows, MAX_PER_HOST_B)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    start = (page - 1) * PAGE_B
    return capped.withColumn("position", place - start).filter((F.col("position") >= 1) & (F.col("position") <= PAGE_B))


def rerank_text(title: Column, description: Column, heading: Column, chunk: Column, most: int = 700) -> Column:
    return F.concat_ws("\n", title, description, heading, F.substring(chunk, 1, most))


def reranked(rows: DataFrame, scorer, depth: int = 50) -> DataFrame:
    """The best ``depth`` of each query in the order of ``scorer(queries, texts) -> scores``, plus ``degraded``.

    A scorer that raises leaves its rows without a score, in fusion order, and marks them ``degraded``.
    """

    def score(batches):
        for batch in batches:
            try:
                batch["rerank_score"], batch["degraded"] = np.asarray(scorer(batch["query"].tolist(), batch["body"].tolist()), np.float64), False
            except Exception:  # any failure of a model is told by the flag
                batch["rerank_score"], batch["degraded"] = np.nan, True
            batch["rerank_score"] = batch["rerank_score"].astype("float64")
            yield batch

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", rerank_score double, degraded boolean"
    scored = rows.filter(F.col("pos") <= depth).mapInPandas(score, schema)
    scored = scored.withColumn("rerank_score", F.when(~F.col("degraded"), F.col("rerank_score")))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "pos")
    return scored.withColumn("reranked", F.row_number().over(order))


def payload(rows: DataFrame, pages: DataFrame, snippet: int = 240) -> DataFrame:
    """What a result shows: query, zone, position, url, host, title, snippet, rounded score; no private field (texts, ranks, verdicts) with it."""
    shown = pages.select("page_id", "host", "title", T.snippet(F.col("text"), snippet).alias("snippet"))
    url = F.concat(F.lit("https://"), F.col("host"), F.lit("/"), F.col("page_id").cast("string"))
    return rows.select("query_id", "zone", "position", "page_id", "score").join(shown, "page_id").select(
        "query_id", "zone", "position", url.alias("url"), "host", "title", "snippet", F.round("score", 6).alias("score")
    )


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """A deterministic stand-in for a cross-encoder: share of query words in the text."""
    out = []
    for q, t in zip(queries, texts):
        want, have = set(q.lower().split()), set(t.lower().split())
        out.append(len(want & have) / max(len(want), 1))
    return out
