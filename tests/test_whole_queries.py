"""Search operators against brute force on small tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import lexicon
from millrace.operators import retrieval as R
from millrace.plans import search as P

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("da", "fe", "gi", "po")]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    pages = [(i, "AB"[i % 2], "xx", f"{text(4)} common", f"{text(4)} common\n" + text(20 + i % 30)) for i in range(60)]
    pages = [(i, z, lang, body.split("\n")[0], body) for i, z, lang, _, body in pages]
    items = [(i, text(6).split()) for i in range(40)]
    vectors = [(i % 150, "AB"[i % 150 % 2], [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    return (
        spark.createDataFrame(pages, "page_id bigint, zone string, lang string, title string, text string"), pages,
        spark.createDataFrame(items, "query_id bigint, terms array<string>"), items,
        spark.createDataFrame(vectors, "page_id bigint, zone string, embedding array<float>"), vectors,
    )


def test_lexical_equals_brute_force(spark, tables):
    df, pages, queries, items, *_ = tables
    more = spark.createDataFrame([(0, 0.9, ["common", "kada"]), (1, 0.5, ["lofe"])], "query_id bigint, weight double, terms array<string>")
    groups = {q: [(0.3, set(terms), True)] for q, terms in items}
    for q, w, terms in [(0, 0.9, {"common", "kada"}), (1, 0.5, {"lofe"})]:
        groups[q].append((w, terms, False))
    want = {}
    for q in groups:
        for zone in "AB":
            scored = []
            for i, z, _, title, body in pages:
                tf = Counter()
                for k, w in enumerate(body.split()):
                    tf[w] += 0.2 + (1.0 if k < len(title.split()) else 0.0)
                score, hit = 0.0, False
                for weight, terms, own in groups[q]:
                    found = [t for t in terms if tf[t]]
                    density = sum(tf[t] / (tf[t] + 1) for t in found) / len(terms)
                    hit |= bool(found)
                    score += weight * density + (2 + density if own and len(found) == len(terms) else 0)
                if z == zone and hit:
                    scored.append((-round(score, 9), i))
            want |= {(q, zone, i): k for k, (_, i) in enumerate(sorted(scored)[:7], 1)}
    got = {(r["query_id"], r["zone"], r["page_id"]): r["lex_rank"] for r in R.lexical(df, queries, more, limit=7).collect()}
    assert got == want


def test_nearest_vectors_equal_brute_force(tables, monkeypatch):
    *_, df, vectors = tables
    queries = df.filter("page_id % 50 = 0").dropDuplicates(["page_id"]).select(F.col("page_id").alias("query_id"), "embedding")
    asked = {r["query_id"]: np.array(r["embedding"]) for r in queries.collect()}
    unit = lambda v: np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float))
    want = {}
    for q, v in asked.items():
        for zone in "AB":
            best = {}
            for i, z, e in vectors:
                if z == zone:
                    best[i] = max(best.get(i, -2), round(float(unit(v) @ unit(e)), 9))
            want |= {(q, zone, i): k for k, i in enumerate(sorted(best, key=lambda i: (-best[i], i))[:5], 1)}
    for most in (R.BROADCAST_QUERIES, 4):
        monkeypatch.setattr(R, "BROADCAST_QUERIES", most)
        got = {(r["query_id"], r["zone"], r["page_id"]): r["sem_rank"] for r in R.semantic(df.repartition(5), queries, 5).collect()}
        assert got == want


@pytest.mark.parametrize(("block", "cells"), [(None, None), (40, 50)])
def test_similar_texts_equal_brute_force(spark, monkeypatch, block, cells):
    if block:
        monkeypatch.setattr(lexicon, "BLOCK_TRIGRAMS", block)
        monkeypatch.setattr(lexicon, "MOST_CELLS", cells)
    rng = random.Random(8)
    text = lambda most: " ".join(rng.choices(WORDS, k=rng.randrange(1, most)))
    # Ids repeat on both sides, with other texts or the same.
    a = [(i % 25, text(8)) for i in range(30)] + [(3, None), (4, "")]
    b = [(i % 150, text(12)) for i in range(200)] + [(5, "kada"), (5, "kada"), (6, None), (None, "kada lofe"), (7, "!?")]
    grams = lambda t: {f"  {w} "[i : i + 3] for w in (t or "").replace("!?", "").split() for i in range(len(w) + 1)}
    want = Counter()
    for i, s in a:
        for j, t in b:
            x, y = grams(s), grams(t)
            if x & y and round(len(x & y) / len(x | y), 6) >= 0.3:
                want[i, j, round(len(x & y) / len(x | y), 6)] += 1
    found = lexicon.similar(spark.createDataFrame(a, "i int, s string"), "i", "s", spark.createDataFrame(b, "j bigint, t string").repartition(3), "j", "t", 0.3)
    assert Counter((r["i"], r["j"], r["similarity"]) for r in found.collect()) == want and len(want) > 100
    none = lexicon.similar(spark.createDataFrame([], "i int, s string"), "i", "s", spark.createDataFrame(b, "j bigint, t string"), "j", "t", 0.3)
    assert none.columns == ["i", "j", "similarity"] and not none.collect()


def test_similar_texts_shuffle_no_text(spark):
    rows = spark.range(50).select("id", F.concat(F.lit("text "), F.col("id")).alias("t"))
    found = lexicon.similar(rows.withColumnRenamed("id", "i"), "i", "t", rows, "id", "t", 0.3)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 50


def test_threads_of_frequent_tags(spark, tables):
    _, pages, *_ = tables
    tags = {i: set(title.split()) for i, _, _, title, _ in pages}
    rows = spark.createDataFrame([(i, list(t), i % 7) for i, t in tags.items()], "page_id bigint, tags array<string>, engagement int")
    got = [(r["seed"], r["page_id"], r["place"]) for r in lexicon.first_overlapping(rows, "page_id", "tags", [-F.col("engagement")], most=3).collect()]
    want = [(i, j, k) for i in tags for k, j in enumerate(sorted((j for j in tags if j != i and tags[i] & tags[j]), key=lambda j: (-(j % 7), j))[:3], 1)]
    assert sorted(got) == sorted(want)


def test_the_best_chunk_is_found_late_in_a_long_page(spark):
    query = "solar sails drift outward quietly"
    filler = "\n\n".join(" ".join(f"f{p}x{i}" for i in range(120)) + "." for p in range(20))
    docs = [(0, f"# One\n\n{filler}\n\n# Two\n\n{query} again " + " ".join(f"t{i}" for i in range(100))), (1, f"solar {filler}"), (2, f"{query} short")]
    rows = spark.createDataFrame([(30, i, i + 1, query) for i in range(3)], "query_id bigint, page_id bigint, pos int, query string")
    met = P._best_chunks(rows, spark.createDataFrame(docs, "page_id bigint, text string"))
    body = met.withColumn("body", R.rerank_text(F.lit(None), F.lit(None), F.col("heading"), F.col("chunk")))
    assert {r["page_id"]: r["rerank_score"] for r in R.reranked(body, R.overlap_scorer).collect()} == {0: 1.0, 1: 0.2, 2: 1.0}

    def broken(queries, texts):
        raise RuntimeError("no model")

    failed = R.reranked(body, broken).collect()
    assert all(r["degraded"] and r["rerank_score"] is None and r["reranked"] == r["pos"] for r in failed)


def test_the_cross_gate_stands_down(spark):
    rows = spark.createDataFrame([(1, 0.9, False), (1, 0.01, False), (2, 0.01, True), (3, None, False)], "query_id int, rerank_score double, hit boolean")
    kept = lambda floor: sorted((r["query_id"], r["rerank_score"]) for r in R.cross_gated(rows, floor, "hit").collect())
    assert kept(0.05) == [(1, 0.9), (2, 0.01), (3, None)] and len(kept(-1)) == 4


def test_stems_by_dictionary(spark):
    words = lambda lang, *w: spark.range(1).select(T.stemmed(F.array(*map(F.lit, w)), F.lit(lang)).alias("s")).first()["s"]
    assert words("en-GB", "walking", "walked", "walks", "is") == ["walk", "walk", "walk", "is"]
    assert words("fr", "grandes") == ["grand"] and words("he", "walks") == ["walks"]
