"""Sizes as set, repeated rows, very long texts, and operators against plain recomputations."""

import hashlib
import json
import random
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import op01_quality, op02_neardup, op03_fingerprints, op04_tables, op05_rules, op06_shards, op07_mixing, op08_counts, op09_pieces, op10_substrings, spm, words
from tests.llm.test_corpus_operators import WORD, brute_removed, shingles

SP = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("word_bpe_49k.json")
random.seed(11)
#: Over a megabyte each: many words, one unbroken word, characters outside the vocabulary, marks of a blank.
LONG = [
    " ".join(f"w{random.randrange(900)}" for _ in range(230_000)),
    "x" * 1_100_000,
    "(龘+鬱)" * 70_000 + "\n" + "ሰላም 𐌰𐌱 " * 60_000,
    "a▁b the▁▁c " * 100_000,
]


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate([*LONG, LONG[0], "short"])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).cache()


def test_splice_at_default_sizes():
    pieces = spm.Pieces.at(SP)
    texts = [*LONG, " ".join("龘鬱" * random.randrange(1, 4) for _ in range(30_000)), "  lead" * 9000, "x" * 40_000 + " " + "龘" * 40_000]
    for text in texts:
        ids, chunks, _ = op08_counts.splice(pieces, text)
        assert ids == pieces.library.encode(text) and chunks >= 1
    for _ in range(1500):
        text = "".join(random.choice("ab the▁ \n龘鬱ሰላም𐌰é,.") for _ in range(random.randrange(1, 60)))
        assert op08_counts.splice(pieces, text, 12, 3)[0] == pieces.library.encode(text)


def test_words_of_any_text_encode_as_the_library():
    tk, own = Tokenizer.from_file(BPE), op04_tables.WordIds(BPE)
    assert own.by_word
    texts = ["İ. Melih geldi", "Sayın İ, ...", "a\x1c. b", "É. x", "it's. x", "<|endoftext|>. a", "A.<|endoftext|>. b, c"]
    parts = ["the", "don't", "İ.", "a.", "B,", "x_,", "1.", "12,", "é.", "q́.", "<|endoftext|>", "'s.", "“hi.”", "...", "a.b."]
    for _ in range(10_000):
        texts.append("".join(random.choice("abc ABC.,.,  \n\n'’!?01é ßÉİıΣς  ́̇\x1c\x85 ﬁ日龘🙂_-<|>") for _ in range(random.randrange(1, 30))))
        texts.append("".join(chr(random.choice((random.randrange(1, 0x250), random.randrange(0x250, 0x3000), random.randrange(0x10000, 0x1F900), 0x20, 0x2E, 0x2C))) for _ in range(random.randrange(1, 25))))
        texts.append(" ".join(random.choice(parts) for _ in range(random.randrange(1, 12))))
    for text in texts:
        assert np.frombuffer(own.encode(text), own.kind).tolist() == tk.encode(text, add_special_tokens=False).ids, repr(text)


def test_another_tokenizer_file_gets_whole_texts(tmp_path):
    spec = json.loads(Path(BPE).read_text())
    spec["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": "_"}, {"type": "Lowercase"}]}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    own, tk = op04_tables.WordIds(str(path)), Tokenizer.from_file(str(path))
    assert not own.by_word
    text = "One two, three. four\nFive"
    assert np.frombuffer(own.encode(text), own.kind).tolist() == tk.encode(text, add_special_tokens=False).ids


def test_long_texts_at_default_sizes(spark, long_docs, tmp_path):
    sp, tk = sentencepiece.SentencePieceProcessor(model_file=SP), Tokenizer.from_file(BPE)
    rows = {r["doc_id"]: r["text"] for r in long_docs.collect()}
    whole = {i: sp.encode(t) for i, t in rows.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in op08_counts.count_tokens(long_docs).collect()} == {i: (len(t.encode()), len(whole[i])) for i, t in rows.items()}
    for r in op09_pieces.with_ids(long_docs).collect():
        assert r["input_ids"] == whole[r["doc_id"]] and r["decoded"] == rows[r["doc_id"]].replace(spm.BLANK, " ")
    manifest = op04_tables.write_shards(long_docs, f"{tmp_path}/sst", parts=2).persist()
    want = {i: zlib.crc32(np.array([*tk.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows.items()}
    assert {r["doc_id"]: r["ids_crc32"] for r in op04_tables.read_shards(manifest).collect()} == want
    assert {r["doc_id"]: r["found_crc32"] for r in op04_tables.look_up(manifest, long_docs.select("doc_id")).collect()} == want
    found = {r["doc_id"]: r for r in op05_rules.repetition(long_docs).collect()}
    for i, text in rows.items():
        w = WORD.findall(text)
        seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {p for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        assert (found[i]["n_words"], found[i]["word_chars"], found[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
    assert sorted(repr(tuple(r)) for r in op10_substrings.digests(long_docs).collect()) == brute_removed(list(rows.items()))
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op02_neardup.near_duplicates(long_docs, 3, 85).collect()}
    assert near == {i: (len(shingles(t, 3)), 0 if i == 4 else i) for i, t in rows.items()}
    prints = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in op03_fingerprints.fingerprints(long_docs).collect()}
    for i, t in rows.items():
        assert prints[i] == (len(t), hashlib.sha256(op03_fingerprints.edited(t, rows[(i + 1) % len(rows)]).encode()).hexdigest())


def test_a_words_hash_does_not_depend_on_its_neighbours():
    def hashes(text):
        raw = text.encode()
        return words.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash.tolist()

    alone, beside = hashes("one two"), hashes("one two " + "z" * 200)
    assert beside[:2] == alone and len({*hashes("z" * 64 + " " + "z" * 65 + " " + "z" * 200)}) == 3
    far = "one two " * 200_000 + "z" * 200 + " one two"
    assert {*hashes(far)} == {*beside}


def plain_simhash(text):
    """Votes of one text, term by term."""
    raw = text.encode()
    found = words.words(words.lowered(np.frombuffer(raw, np.uint8)), np.array([0, len(raw)]))
    hashes, sizes = found.hash.tolist(), (found.end - found.start).tolist()
    terms = [(h, min(n, op03_fingerprints.WORD_MOST)) for h, n in zip(hashes, sizes)]
    for a, b in zip(hashes, hashes[1:]):
        both = (a * 0xC2B2AE3D27D4EB4F + b * 0x165667B19E3779F9) % 2**64
        terms.append((int(words.mix(np.array([both], np.uint64))[0]), op03_fingerprints.PAIR_WEIGHT))
    votes = [sum(w if h >> bit & 1 else -w for h, w in terms) for bit in range(64)]
    return sum(1 << bit for bit, v in enumerate(votes) if v > 0)


def test_votes_equal_a_plain_simhash(corpus):
    texts = [r["text"] for r in corpus.limit(60).collect()] + ["", " ", "one", "one two", "A a A a", LONG[0][:30_000], "x" * 5000, "é 日本 🙂 " * 300]
    assert op03_fingerprints.simhash(pa.array(texts)).tolist() == [plain_simhash(t) for t in texts]


def test_mix_takes_repeated_rows_one_by_one(spark, corpus):
    rows = [(7, "a b c d", f"src{i % 2}", i) for i in range(50)] + [(7, "e f g h", "src1", 1)] * 5 + [(None, "k l m n", None, 2)] * 9
    repeated = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int").repartition(3)
    for docs in (repeated, corpus):
        want = {(r["source"], r["tag"]): r["n"] for r in op07_mixing.mixed(op07_mixing.sized(docs)).groupBy("source", "tag").agg(F.sum(F.size("draws")).alias("n")).collect() if r["n"]}
        out = op07_mixing.mix(docs)
        got = {(r["source"], r["tag"]): r["n"] for r in out.groupBy("source", F.xxhash64("text").alias("tag")).agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == want and out.columns == docs.columns
        assert sorted(map(repr, out.collect())) == sorted(map(repr, op07_mixing.mix(docs).collect()))


def test_a_refused_giant_is_in_no_others_way(spark):
    rows = [(i, "w " * 10, "small", i) for i in range(600)] + [(700, "g " * 6000, "small", 0)] + [(800 + i, "v " * 30, "large", 0) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, x int")
    for weights in ((1, 1), (2, 1), (1, 4)):
        out = op07_mixing.mixed(op07_mixing.sized(docs), weights=weights)
        for r in out.groupBy("source").agg(F.sum(F.col("size") * F.size("draws")).alias("taken"), F.first("target").alias("target")).collect():
            assert abs(r["taken"] - r["target"]) <= 15, (weights, r)


def test_targets_equal_a_plain_recomputation(corpus):
    rows = op07_mixing.mixed(op07_mixing.sized(corpus)).collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(WORD.findall(next(iter([r["size"]])) and "w " * r["size"]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        left = sum(size.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        aims = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s: 3 * size[s] for s in free if aims[s] > 3 * size[s]}
        if not over:
            break
        fixed |= over
    want = aims | fixed
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]] for r in rows)


def test_shards_equal_a_plain_rendezvous(spark, corpus, awkward):
    def winner(key, n):
        draws = []
        for s in range(n):
            h = xxhash.xxh64(struct.pack("<i", s), seed=42).intdigest()
            draws.append((xxhash.xxh64(struct.pack("<q", key), seed=h).intdigest() if key is not None else h) >> 11)
        return draws.index(max(draws))

    for docs in (corpus, awkward):
        rows = op06_shards.sharded(docs, [1.0] * 40, [1.0] * 41).collect()
        assert all((r["shard"], r["grown_shard"]) == (winner(r["doc_id"], 40), winner(r["doc_id"], 41)) for r in rows)
        by_shard = {}
        for r in rows:
            by_shard.setdefault(r["shard"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"], r["slot"]))
        for held in by_shard.values():  # slots follow key, size and checksum, so reruns agree
            assert [h[-1] for h in sorted(held)] == list(range(len(held)))


def test_tree_scan_resolves_as_the_plain_scan(spark):
    lattice = op09_pieces.Lattice.at(SP)
    texts = ["internationalization of tokenization everywhere " * 20, "日本語 é🙂 the" * 30]
    table, want = [], {}
    for row, text in enumerate(texts):
        marked = spm.BLANK + text.replace(" ", spm.BLANK)
        cuts = op09_pieces._cuts(len(marked), 37)
        matrices = [lattice.matrix(marked, a, b) for a, b in zip(cuts, cuts[1:])]
        want |= {(row, k): w for k, w in enumerate(op09_pieces.resolved(matrices))}
        table += [(row, k, bytearray(op09_pieces._packed(m))) for k, m in enumerate(matrices)]
    df = spark.createDataFrame(table, "__row bigint, k int, matrix binary")
    for fan in (2, 3, 256):
        assert {(r["__row"], r["k"]): (r["x"], r["y"]) for r in op09_pieces._ways(df, fan).collect()} == want


def test_classifier_on_documents(spark):
    path = "/root/testdata/sf0.01"
    if not Path(path).exists():
        pytest.skip("no shared documents")
    labels = spark.read.parquet(f"{path}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = op01_quality.op1_quality_classifier(spark, path).filter("held_out").join(labels.filter("quality IS NOT NULL"), "doc_id").collect()
    right = np.array([r["predicted"] == r["quality"] for r in rows])
    score, truth = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    assert len(rows) > 50 and right.mean() > 0.97
    bins = np.clip((score * 10).astype(int), 0, 9)
    off = sum(abs(score[bins == b].mean() - truth[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))
    assert off < 0.05 and np.mean((score - truth) ** 2) < 0.03


def test_classifier_fit_does_not_depend_on_row_order(spark):
    docs = spark.createDataFrame([(i % 40, f"{'good words here' if i % 2 else 'BAD ### !!!'} {i}") for i in range(160)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    scores = [
        {(r["doc_id"], round(r["score"], 9)) for r in op01_quality.scored(docs, *op01_quality.train(op01_quality.fitting_sample(d, labels))).collect()}
        for d in (docs.repartition(3), docs.orderBy(F.col("text").desc()).coalesce(1))
    ]
    assert scores[0] == scores[1]
