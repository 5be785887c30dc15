"""Operators whose queries have no SQL, or only part of whose cases the fixtures hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import admin as A
from millrace.operators import embedding as M
from millrace.operators import frontier as C
from millrace.operators import identity as I
from millrace.operators import shared
from millrace.plans import graph


def test_vectors_come_in_batches_and_failures_are_tried_again(spark, tmp_path):
    rows = [(i, "Title" if i % 2 else "", "Head" if i % 3 else None, f"text {i}" if i else None) for i in range(100)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, title string, heading string, text string").coalesce(1)
    plain = M.hashed_provider(8)
    got = {r["chunk_id"]: r for r in M.embedded(chunks, plain, "m1").collect()}
    for i, title, heading, text in rows:
        prefix = " > ".join(x for x in (title, heading) if x)
        want = plain([f"{prefix}\n\n{text or ''}".rstrip("\n") if prefix and text else (f"{prefix}\n\n" if prefix and text is not None else text or prefix)])[0]
        if text:
            assert np.allclose(got[i]["embedding"], want, atol=1e-6) and abs(np.linalg.norm(want) - 1) < 1e-9
    assert all(r["model"] == "m1" and r["attempts"] == 1 for r in got.values())

    def failing(texts):
        raise RuntimeError("down")

    left = M.embedded(chunks, failing, "m1").collect()
    assert all(r["embedding"] is None and r["model"] is None and r["attempts"] == M.ATTEMPTS for r in left)
    assert (M.hashed_provider(8)([""]) == 0).all()


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((12, 16)) * 3
    points = [(i, (middle[i % 12] + rng.standard_normal(16)).tolist()) for i in range(1500)]
    v = spark.createDataFrame(points, "page_id bigint, embedding array<float>").repartition(4)
    asked = v.filter("page_id % 50 = 0").withColumnRenamed("page_id", "query_id")
    lists = M.centroids(v, 24)
    found = {}
    for r in M.nearest(v, asked, lists, probes=6, limit=10).collect():
        found.setdefault(r["query_id"], set()).add(r["page_id"])
    m = np.array([p for _, p in points], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = [len(found[q] & set(np.argsort(-(m @ m[q]))[:10].tolist())) for q in range(0, 1500, 50)]
    assert np.mean(hits) / 10 >= 0.9
    whole = M.nearest(v, asked, lists, probes=len(lists), limit=10).collect()
    for q in (0, 50):
        assert {r["page_id"] for r in whole if r["query_id"] == q} == set(np.argsort(-(m @ m[q]), kind="stable")[:10].tolist())


def test_near_pairs_and_components_equal_brute_force(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) - 2**63 for _ in range(80)]
    for v in list(values[:30]):
        for _ in range(2):
            x = v
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(63)
            values.append(x)
    pages = [(i, v) for i, v in enumerate(values + values[:10])]
    df = spark.createDataFrame(pages, "page_id bigint, simhash bigint")
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    distinct = sorted(set(values))
    want = {(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if apart(a, b) <= 3}
    pairs = I.near_pairs(df)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    group = {v: v for v in distinct}
    for _ in distinct:
        for a, b in want:
            group[a] = group[b] = min(group[a], group[b])
    first = {}
    for i, v in pages:
        first[group[v]] = min(i, first.get(group[v], i))
    got = {r["page_id"]: r["duplicate_of"] for r in I.resolved(df, pairs, []).collect()}
    assert got == {i: (first[group[v]] if first[group[v]] != i else None) for i, v in pages}


def test_near_pairs_are_not_met_through_the_driver(spark):
    prints = shared.written(spark.range(1000).select(F.xxhash64("id").alias("simhash")), "prints")
    pairs = I.near_pairs(prints)
    pairs.collect()
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_near_copies_are_not_resolved_through_the_driver(spark, tmp_path, monkeypatch):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(40))) for k in range(30)]
    rows += [(100 + k, text) for k, text in rows[:5]]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return shared.written(df, name)

    monkeypatch.setattr(graph, "written", noted)
    got = {r["page_id"]: r["duplicate_of"] for r in graph.near_dup_resolve(spark, str(tmp_path)).collect()}
    assert "Join" in plans["near-pairs"] and "Broadcast" not in plans["near-pairs"]
    assert len(got) == 30 + 3 + 5 + 1 and all(got[100 + k] == k for k in range(5))


def test_no_round_of_resolving_goes_through_the_driver(spark):
    chain = [(i, (1 << i) - 1) for i in range(40)] + [(100, 0), (101, (1 << 62) - 1)]
    prints = shared.written(spark.createDataFrame(chain, "page_id bigint, simhash bigint"), "prints")
    pairs = shared.written(I.near_pairs(prints), "pairs")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = {r["page_id"]: r["duplicate_of"] for r in I.resolved(prints, pairs, []).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    plans = [runs.apply(k).physicalPlanDescription() for k in range(before, runs.size())]
    assert len(plans) > 3 and sum("SortMergeJoin" in p for p in plans) > 2 and not any("Broadcast" in p for p in plans)
    assert got == {i: 0 if 0 < i < 101 else None for i, _ in chain}


def test_simhash_of_repeated_keys(spark):
    rows = [(1, "one two three four five"), (1, "six seven eight nine ten"), (2, None), (2, "")]
    found = [r["simhash"] for r in I.simhashes(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", F.col("text")).collect()]
    assert len(set(found[:2])) == 2 and found[2:] == [0, 0]


def test_ranged_totals(spark):
    rows = [(k % 3, k, k % 5) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, o int, n int").repartition(5)
    got = {(r["g"], r["o"]): r["total"] for r in shared.ranged(df, ["g"], [F.col("o")], {"total": F.col("n")}).collect()}
    assert got == {(g, o): sum(n for h, p, n in rows if h == g and p <= o) for g, o, _ in rows}


def test_sitemap_circles_end(spark):
    listed = spark.createDataFrame([("a", "b", "index"), ("b", "a", "index"), ("b", "p1", "page"), ("a", "p2", "page"), ("x", "p3", "page")], "sitemap string, url string, kind string")
    found = {r["url"]: r["depth"] for r in C.seeded(spark.createDataFrame([("a",)], "url string"), listed).collect()}
    assert found == {"p1": 2, "p2": 1}


@pytest.mark.parametrize(("heads", "topics", "want"), [((0.1, 0.1), (0.1, 0.8), (True, 0.9, "")), ((0.9, 0.1), (0.1, 0.8), (False, 0.6, "toxic")), ((0.0, 0.0), (0.55, 0.3), (False, 0.55, "gambling")), ((None, None), (None, None), (True, 1.0, ""))])
def test_family_verdict(spark, heads, topics, want):
    c = lambda v: F.lit(v).cast("double")
    made = A.family_verdict({"toxic": c(heads[0]), "insult": c(heads[1])}, [("gambling", c(topics[0]), True), ("news", c(topics[1]), False)])
    row = spark.range(1).select(*(col.alias(n) for n, col in made.items())).first()
    assert (row["safe"], row["confidence"], row["flags"]) == want
