import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import op01_quality, op03_fingerprints, op04_tables, op05_rules, op08_counts, op09_pieces, spm, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SP = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b ", "\n", "a\nb", "▁x ▁", "日本語 é🙂", "a" * 500, "ab" * 300, "<s> <0x41> </s>", "x\n\n\n" * 50, " lead" * 40]
ODD += ["Don't STOP!!! É À", "a<|endoftext|>b <|ENDOFTEXT|>", "ß İ Σς ﬁ", "a, b. c.\nd ., e_. f", "q́, a", "12345 x1y2"]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_words_follow_the_pattern():
    texts = [*ODD, "a\x0bb\x0cc\x1cd\x85e", "z" * 200 + " " + "z" * 200 + "y"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    found = words.words(data, offsets)
    for i, t in enumerate(texts):
        a, b = found.first[i], found.first[i + 1]
        assert [data[s:e].tobytes().decode() for s, e in zip(found.start[a:b], found.end[a:b])] == WORD.findall(t)
    everything = [w for t in texts for w in WORD.findall(t)]
    assert len(set(found.hash.tolist())) == len(set(everything))


def test_rules_equal_brute_force(corpus, awkward, nothing):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = by_id(op05_rules.repetition(corpus), *columns)
    for r in corpus.collect():
        w = WORD.findall(r["text"] or "")
        seen, covered = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7)), set()
        for j in range(len(w) - 7):
            if seen[tuple(w[j : j + 8])] > 1:
                covered.update(range(j, j + 8))
        lines = [x for x in (r["text"] or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r["text"] or "")), len(lines) - len(set(lines)), len(covered))
        assert got[r["doc_id"]] == (*want, len(w) < 20 or 100 * len(covered) > 30 * len(w))
    rows = op05_rules.repetition(awkward).collect()
    assert len(rows) == awkward.count() and all(not r["kept"] for r in rows if r["n_words"] == 0)
    assert all(not r["kept"] for r in rows if r["doc_id"] == 8)  # one pair of words over and over
    assert op05_rules.repetition(nothing).count() == 0
    clean = op05_rules.keep_clean(awkward)
    assert clean.columns == awkward.columns and clean.count() == sum(r["kept"] for r in rows)


def test_token_counts_equal_the_library(corpus, awkward, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    for docs in (corpus, awkward):
        rows = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op08_counts.count_tokens(docs, huge=400, chunk=100, overlap=8).collect()}
        want = {(r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in docs.collect()}
        assert rows == {(*w, w[2] > 4096) for w in want}
    assert op08_counts.count_tokens(nothing).count() == 0
    pieces = spm.Pieces.at(SP)
    for text in ODD:
        if text and spm.BLANK not in text:
            assert op08_counts.splice(pieces, text * 3, 50, 4)[0] == sp.encode(text * 3)


def test_scan_equals_the_library_and_decodes(corpus, awkward, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    random.seed(4)
    texts = [t for t in ODD if spm.BLANK not in t] + ["".join(random.choice("thein ,\né🙂") for _ in range(700))]
    for chunk in (5, 64):
        for text in texts:
            assert op09_pieces.scan_encode(SP, text, chunk) == sp.encode(text)
    for docs in (corpus, awkward):
        rows = op09_pieces.encoded(docs.select("doc_id", "text"), giant=900, chunk=300).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert np.frombuffer(r["ids"], np.uint16).tolist() == sp.encode(r["text"] or "") and r["decoded"] == (r["text"] or "")
    made = op09_pieces.with_ids(awkward)
    assert made.count() == awkward.count() and made.columns == ["doc_id", "source", "n_tokens", "input_ids", "decoded"]
    assert op09_pieces.with_ids(nothing).count() == 0


def test_matrix_products_are_associative():
    lattice = op09_pieces.Lattice.at(SP)
    text = spm.BLANK + "internationalization▁of▁tokenization▁everywhere▁"
    cuts = [0, 9, 20, 31, len(text)]
    a, b, c, d = (lattice.matrix(text, x, y) for x, y in zip(cuts, cuts[1:]))
    both = op09_pieces.combined
    assert both(both(a, b), both(c, d)) == both(a, both(b, both(c, d))) == lattice.matrix(text, 0, len(text))


def test_tables_round_trip_and_look_up(spark, corpus, awkward, nothing, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tk, own = Tokenizer.from_file(path), op04_tables.WordIds(path)
    for text in ODD:
        assert np.frombuffer(own.encode(text), own.kind).tolist() == tk.encode(text, add_special_tokens=False).ids, text
    for k, docs in enumerate((corpus, awkward)):
        manifest = op04_tables.write_shards(docs, f"{tmp_path}/sst{k}", parts=3).persist()
        files = manifest.collect()
        rows = sorted(map(tuple, op04_tables.read_shards(manifest).collect()), key=lambda r: r[1])
        want = []
        for r in docs.collect():
            ids = [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert sorted(map(repr, want)) == sorted(repr((r[0], r[2], r[3])) for r in rows)
        assert [r[1] for r in rows] == np.cumsum([0, *(r[2] for r in rows)])[:-1].tolist()
        keys = [r[0] for r in rows]
        assert keys == sorted(keys, key=lambda i: (i is not None, i or 0))
        for f in files:
            system, name = op04_tables._open(f["path"])
            with system.open_input_file(name) as source:
                shard = op04_tables.Reader(source, f["length"])
                first = {}
                for key, ids in shard:
                    first.setdefault(key, ids)
                assert all(shard.get(key) == ids for key, ids in first.items() if key is not None)
                assert shard.get(10**12) is None
        ids = {r[0]: r[3] for r in reversed(rows)}
        asked = spark.createDataFrame([(i,) for i in [*{r["doc_id"] for r in docs.collect()}, 10**12, -4]], "doc_id bigint")
        found = {r["doc_id"]: r["found_crc32"] for r in op04_tables.look_up(manifest, asked).collect()}
        assert found == {i: ids.get(i) for i in found} and len(found) == len(set(ids) - {None}) + 2
    empty = op04_tables.write_shards(nothing, f"{tmp_path}/none", parts=3)
    assert empty.count() == 0 and op04_tables.read_shards(empty).count() == 0
    assert {r["found_crc32"] for r in op04_tables.look_up(empty, spark.range(3).toDF("doc_id")).collect()} == {None}


def test_fingerprints_next_texts_and_search(spark, corpus, awkward, nothing):
    got = by_id(op03_fingerprints.fingerprints(corpus), "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next")
    docs = sorted(((r["doc_id"], r["text"]) for r in corpus.collect()))
    own = op03_fingerprints.simhash(pa.array([t for _, t in docs]))
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        n = len(text) // 2
        changed = text[: len(text) - n] + following[:n]
        new = op03_fingerprints.simhash(pa.array([changed, following]))
        like = tuple(op03_fingerprints.likeness(own[k : k + 1], new[j : j + 1])[0] for j in (0, 1))
        assert got[i] == (len(text), hashlib.sha256(changed.encode()).hexdigest(), f"{int(own[k]):016x}", *like)
    assert op03_fingerprints.fingerprints(awkward).count() == awkward.count() and op03_fingerprints.fingerprints(nothing).count() == 0
    random.seed(1)
    values = [random.getrandbits(64) for _ in range(150)]
    values += [v ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for v in values]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed * 2], "fingerprint bigint")
    found = {(r["asked"], r["found"]): r["distance"] for r in op03_fingerprints.within_radius(df, df, 3).collect()}
    distinct = sorted(set(signed))
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert found == {(a, b): apart(a, b) for a in distinct for b in distinct if a != b and apart(a, b) <= 3}


def test_classifier_learns_calibrates_and_survives(spark, awkward, nothing):
    random.seed(3)
    good = [" ".join(random.choice(["the", "quick", "brown", "fox", "Jumps", "over,", "dog."]) for _ in range(80)) for _ in range(150)]
    bad = [" ".join(random.choice(["BUY!!", "NOW!!", "###", "$$$"]) for _ in range(80)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)], "doc_id bigint, quality int")
    sample = op01_quality.fitting_sample(docs, labels)
    assert sample.filter(op01_quality.fold(F.col("doc_id")) == op01_quality.HELD).count() == 0
    rows = op01_quality.scored(docs, *op01_quality.train(sample)).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 300 and held and np.mean([(r["predicted"] == 1) == (r["doc_id"] < 150) for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    out = op01_quality.scored(awkward, *op01_quality.train(sample)).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
    none = op01_quality.train(op01_quality.fitting_sample(docs, labels.filter("quality > 5")))
    assert {r["score"] for r in op01_quality.scored(docs.limit(3), *none).collect()} == {0.5}
    assert op01_quality.scored(nothing, *none).count() == 0
