import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import graph, op02_neardup, op06_shards, op07_mixing, op10_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = defaultdict(list)
    for i, text in rows:
        if i is not None:
            sets[i].append(shingles(text, k))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[i] for t in sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(corpus, awkward, nothing, k, percent):
    for docs in (corpus, awkward):
        rows = docs.select("doc_id", "text").collect()
        want = brute_components(rows, k, percent)
        found = op02_neardup.near_duplicates(docs, k, percent).collect()
        assert len(found) == len(rows)
        sizes = defaultdict(set)
        for i, text in rows:
            sizes[i].add(len(shingles(text, k)))
        for r in found:
            assert r["n_shingles"] in sizes[r["doc_id"]] and r["component_id"] == want.get(r["doc_id"])
            assert r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"])
    if k == 5:
        assert op02_neardup.near_duplicates(nothing, k, percent).count() == 0
        kept = op02_neardup.keep_one(awkward, k, percent)
        assert kept.columns == awkward.columns and kept.count() < awkward.count()


def test_one_row_of_an_id_stays(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "h i j k l m n"), (2, "o p q r s t u"), (3, "o p q r s t u"), (None, "a b c d e f g"), (None, "a b c d e f g"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = [r["doc_id"] for r in op02_neardup.keep_one(docs).collect()]
    assert sorted(kept, key=repr) == [1, 2, 4, None, None]


def test_a_family_that_stars_leave_open(spark, monkeypatch):
    """A chain of texts, each near the next but far from the one after: links must come from the block comparison as well."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[10 * i : 10 * i + 150]) for i in range(20)]
    monkeypatch.setattr(op02_neardup, "STAR_ROUNDS", 1)
    monkeypatch.setattr(op02_neardup, "BLOCK", 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = op02_neardup.near_duplicates(docs, 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(list(enumerate(texts)), 3, 85)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)], "a bigint, b bigint")
    found = {r["id"]: r["label"] for r in graph.components(links).collect()}
    assert all(found[i] == 1 for i in range(1, 41)) and found[100] == found[95] == 90
    assert graph.components(links.filter("a < 0")).count() == 0


def test_shards_slots_and_growth(spark, corpus, awkward, nothing):
    rows = op06_shards.sharded(corpus, [1.0] * 40, [1.0] * 41).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and any(r["grown_shard"] == 40 for r in rows)
    text = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    assert op06_shards.sharded(awkward, [1.0, 2.0, 5.0]).count() == awkward.count() and op06_shards.sharded(nothing, [1.0]).count() == 0
    keys = spark.range(6000).select(op06_shards.shard_of(F.col("id"), [1.0, 2.0, 3.0]).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 6000 for r in keys}
    assert all(abs(share[s] - (s + 1) / 6) < 0.03 for s in range(3))
    null = op06_shards.sharded(awkward.filter("doc_id IS NULL OR text IS NULL"), [1.0] * 4).collect()
    assert all(r["size"] >= 16 and r["shard"] is not None for r in null)


def test_targets_are_dealt_anew():
    assert op07_mixing.targets([100, 100], [1, 1]) == [100, 100]
    assert op07_mixing.targets([10, 990], [5, 2]) == [30, 970]
    got = op07_mixing.targets([1, 5, 994], [5, 2, 1])
    assert got[:2] == [3, 15] and abs(sum(got) - 1000) < 1e-9


def test_tree_keeps_both_totals():
    quotas = [13, 0, 7, 100]
    tree = op07_mixing.splitting_tree(quotas, 7)
    assert tree.sum(axis=0).tolist() == quotas and max(tree.sum(axis=1)) - min(tree.sum(axis=1)) <= 2 and (tree >= 0).all()
    assert (tree == op07_mixing.splitting_tree(quotas, 7)).all()


def test_mix_meets_targets(corpus, awkward, nothing):
    rows = op07_mixing.mixed(op07_mixing.sized(corpus), block_words=2000).collect()
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3 and len(r["draws"]) == r["copies"]
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert sorted(map(repr, rows)) == sorted(map(repr, op07_mixing.mixed(op07_mixing.sized(corpus), block_words=2000).collect()))
    assert op07_mixing.mixed(op07_mixing.sized(awkward)).count() == awkward.count() and op07_mixing.mixed(op07_mixing.sized(nothing)).count() == 0
    whole = sum(r["copies"] for r in op07_mixing.mixed(op07_mixing.sized(corpus)).collect())
    out = op07_mixing.mix(corpus)
    assert out.columns == corpus.columns and out.count() == whole
    assert op07_mixing.mix(awkward).columns == awkward.columns


def brute_removed(rows):
    first, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(text or "")
        gone = set()
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            if i is not None and first.get(key, i) < i:
                gone.update(range(j, j + 50))
            elif i is not None:
                first.setdefault(key, i)
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(map(repr, out))


def test_substrings_equal_brute_force(spark, corpus, awkward, nothing, monkeypatch):
    for docs in (corpus, awkward):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert sorted(repr(tuple(r)) for r in op10_substrings.digests(docs).collect()) == brute_removed(rows)
    assert op10_substrings.digests(nothing).count() == 0
    cut = op10_substrings.without_repeats(awkward)
    assert cut.columns == awkward.columns and cut.count() == awkward.count()
    assert all(r["n_chars"] == len(r["text"]) for r in cut.filter("text IS NOT NULL").collect())
    # Many distinct spans of one passage: several blocks meet.
    monkeypatch.setattr(op10_substrings, "BLOCK", 3)
    passage = " ".join(f"p{i}" for i in range(60))
    many = [(i, f"a{i} b{i} " * 20 + passage + f" c{i} d{i}" * 20) for i in range(12)] + [(20, passage + " " + passage), (21, "to " * 200)]
    docs = spark.createDataFrame(many, "doc_id bigint, text string")
    assert sorted(repr(tuple(r)) for r in op10_substrings.digests(docs).collect()) == brute_removed(many)


def test_windows_across_two_matches_are_known(spark):
    """A span that two earlier spans cover together, but neither holds, makes later documents lose words as well."""
    base = [f"w{i}" for i in range(90)]

    def edited(*places):
        return " ".join(f"e{i}" if i in places else w for i, w in enumerate(base))

    family = [(1, edited(61)), (2, edited(29)), (3, edited()), (4, edited(19, 70))]
    rng = random.Random(7)
    for f in range(40):
        base = [f"f{f}w{i}" for i in range(90)]
        family += [(10 + 10 * f + n, edited(*rng.sample(range(90), rng.randrange(4)))) for n in range(8)]
    docs = spark.createDataFrame(family, "doc_id bigint, text string").repartition(3)
    rows = op10_substrings.digests(docs).collect()
    assert sorted(repr(tuple(r)) for r in rows) == brute_removed(family)
    assert {r["doc_id"]: r["n_removed"] for r in rows}[4] == 50


def test_automaton_and_known_reference(spark):
    grown = op10_substrings.Automaton()
    grown.add("a b c d e".split())
    grown.add("c d x y".split())
    assert grown.matches("z a b c q c d x y".split(), 3) == [(1, 4), (5, 9)] and grown.matches("d e x".split(), 3) == []
    passage = " ".join(f"p{i}" for i in range(130))
    docs = spark.createDataFrame([(1, "x " + passage + " y"), (2, "none"), (3, None)], "doc_id bigint, text string")
    found = {r["doc_id"]: [(x["lo"], x["hi"]) for x in r["ranges"]] for r in op10_substrings.known_spans(docs, [passage], shard_words=100).collect()}
    covered = set().union(*(range(a, b) for a, b in found[1]))
    assert covered == set(range(1, 131)) and found[2] == found[3] == []
