"""Substring deduplication by suffix automata over reference shards.

A word of a document is removed if a window of ``WINDOW`` words that covers it also begins in
a document with a smaller id.  Automata of the whole corpus would grow with it and
cannot be broadcast, so a reference shard holds what can match, and is sent where it is needed:

* Anchors: of every window the ``GRAM``-word sequence with the least hash is marked, so
  two documents that share a window share an anchor in it.  The span of an anchor is all
  windows that hold it (at most ``2 * WINDOW - GRAM`` words).
* An anchor that only one document has is dropped.  A span that another document with a smaller id
  has word for word is a copy as a whole.
* What is left are the distinct spans of an anchor, each at its first document.  They are
  dealt into blocks; each pair of blocks is a group of bounded size.  In a group a suffix
  automaton grows span by span in ascending order of documents, and every span is
  streamed through it first: its matching statistics give the maximal matches with smaller documents, and
  those of at least ``WINDOW`` words are removed.

``known_spans`` is the form for a small, fixed reference: its automata, of bounded size, are broadcast and whole
documents are streamed through them.

Edge cases: null and empty texts have no words; texts below ``WINDOW`` words lose none.  Rows that share an id do
not count as smaller than each other.  A null id is larger than none and smaller than none:
such rows neither lose words nor make others lose them.  Of equal documents the smallest id keeps its words.  A very long
text is marked in slices of words over its whole length.  An empty table gives no rows; ``without_repeats`` keeps
all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.words import mix, windows, words

WINDOW, GRAM = 50, 10
#: Distinct spans of a block; a group holds two blocks.
BLOCK = 1024
#: Spans that a task streams, on average.
TASK_SPANS = 16_384
#: Most words of one broadcast automaton.
SHARD_WORDS = 200_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


class Automaton:
    """Suffix automaton of a set of word sequences, one added after another."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: Sequence) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)

    def _extend(self, last: int, word) -> int:
        goes, link, length = self.next, self.link, self.length
        if word in goes[last]:
            to = goes[last][word]
            return to if length[to] == length[last] + 1 else self._clone(last, word, to)
        new = len(goes)
        goes.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and word not in goes[at]:
            goes[at][word] = new
            at = link[at]
        if at != -1:
            to = goes[at][word]
            link[new] = to if length[to] == length[at] + 1 else self._clone(at, word, to)
        return new

    def _clone(self, at: int, word, to: int) -> int:
        goes, link, length = self.next, self.link, self.length
        twin = len(goes)
        goes.append(dict(goes[to]))
        length.append(length[at] + 1)
        link.append(link[to])
        link[to] = twin
        while at != -1 and goes[at].get(word) == to:
            goes[at][word] = twin
            at = link[at]
        return twin

    def matches(self, sequence: Sequence, least: int) -> list[tuple[int, int]]:
        """Maximal ranges of ``sequence`` covered by matches of at least ``least`` words."""
        goes, link, length = self.next, self.link, self.length
        state = run = 0
        out: list[tuple[int, int]] = []
        for i, word in enumerate(sequence):
            while state and word not in goes[state]:
                state = link[state]
                run = length[state]
            if word in goes[state]:
                state = goes[state][word]
                run += 1
            if run >= least:
                lo = i + 1 - run
                if out and lo <= out[-1][1]:
                    out[-1] = (min(out[-1][0], lo), i + 1)
                else:
                    out.append((lo, i + 1))
        return out

    def holds(self, sequence: Sequence) -> bool:
        """Whether ``sequence`` as a whole lies in one of the added sequences."""
        goes, state = self.next, 0
        for word in sequence:
            if word not in goes[state]:
                return False
            state = goes[state][word]
        return True


def _least_in_window(value: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span, out = 1, value
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def anchors(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, word position, anchor hash and span hash of every anchor of a column of texts."""
    data, offsets = common.text_buffers(column)
    parts = []
    width = WINDOW - GRAM + 1
    for lo, hi in common.slices(offsets):
        found = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n = len(found.hash)
        if n < WINDOW:
            continue
        gram = np.zeros(n, np.uint64)
        value, at = windows(found.hash, found.first, GRAM)
        gram[at] = value
        # The low bits make the rightmost of equal hashes the least, so the choice depends on the window alone.
        place = np.uint64(0xFFFFF) - (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFF))
        least = _least_in_window((gram & ~np.uint64(0xFFFFF)) | place, width)
        row = found.row
        start = np.arange(len(least))
        whole = start[: n - WINDOW + 1]
        whole = whole[row[whole] == row[whole + WINDOW - 1]]
        back = (np.uint64(0xFFFFF) - (least[whole] & np.uint64(0xFFFFF))).astype(np.int64)
        pos = whole + ((back - whole) & 0xFFFFF)
        pos = np.unique(pos)
        r = row[pos]
        begin, end = np.maximum(found.first[r], pos + GRAM - WINDOW), np.minimum(found.first[r + 1], pos + WINDOW)
        power = np.cumprod(np.full(n, _BASE, np.uint64))
        back_power = np.cumprod(np.full(n, _INVERSE, np.uint64))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(found.hash * power, out=total[1:])
        span = (total[end] - total[begin]) * back_power[begin]
        span = mix(span + mix((end - begin).astype(np.uint64) << np.uint64(32) | (pos - begin).astype(np.uint64)))
        parts.append((lo + r, pos - found.first[r], gram[pos], span))
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return tuple(np.concatenate(p) for p in zip(*parts))


_KEYED = "doc_id bigint, tag bigint"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text: tells rows apart that share an id), text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text"))


def _occurrences(docs: DataFrame) -> DataFrame:
    def mark(batches):
        for batch in batches:
            row, pos, gram, span = anchors(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    pa.array(pos.astype(np.int32)),
                    pa.array(gram.view(np.int64)),
                    pa.array(span.view(np.int64)),
                ],
                ["doc_id", "tag", "pos", "anchor", "span"],
            )

    return _keyed(docs).filter(F.col("doc_id").isNotNull()).mapInArrow(mark, f"{_KEYED}, pos int, anchor bigint, span bigint")


def _split(text: str) -> list[bytes]:
    """Words of a text; ``bytes.split`` parts at exactly space and 0x09-0x0D."""
    return text.encode().split()


def _spans_of(first: DataFrame, docs: DataFrame) -> DataFrame:
    """The words of each distinct span, cut from its first document."""
    wanted = first.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "span", "pos")).alias("wanted"))
    held = _keyed(docs).join(wanted, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = _split(text)
                for w in wanted:
                    lo = max(0, w["pos"] + GRAM - WINDOW)
                    out.append((w["anchor"], w["span"], doc_id, w["pos"] - lo, b" ".join(parts[lo : w["pos"] + WINDOW])))
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return held.select("doc_id", "text", "wanted").mapInArrow(cut, "anchor bigint, span bigint, doc_id bigint, lead int, words binary")


def _batch(out: list[tuple]) -> pa.RecordBatch:
    a = list(zip(*out)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(a, kinds)], ["anchor", "span", "doc_id", "lead", "words"])


def _matched(spans: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """anchor, span and the ranges (from the anchor) that match spans of smaller documents; ``firsts``: the spans without their words."""
    counts = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    counts = common.written(counts, "span-counts")
    placed = spans.join(counts.drop("n"), "anchor").withColumn("own", F.pmod(F.xxhash64("span"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"i": F.least("own", "other"), "j": F.greatest("own", "other")}
    )
    # Small groups share a call: anchors are gathered by a hash, about a block's worth of spans a call; large ones stand alone.
    total = counts.agg(F.count(F.lit(1)).alias("anchors"), F.sum("n").alias("spans"), F.sum(F.col("blocks") * F.col("n")).alias("dealt")).first()
    calls = max(1, (total["spans"] or 0) // BLOCK)
    tasks = max(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total["dealt"] or 0) // TASK_SPANS)
    several = F.when(F.col("blocks") > 1, F.xxhash64("anchor", "i", "j")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(calls)))

    def stream(table):
        anchor, i, j = (table.column(c).to_pylist() for c in ("anchor", "i", "j"))
        span, doc, lead, text = (table.column(c).to_pylist() for c in ("span", "doc_id", "lead", "words"))
        out: list[tuple] = []
        order = sorted(range(len(anchor)), key=lambda r: (anchor[r], i[r], j[r], doc[r], span[r]))
        group, grown, waiting, at = None, None, [], None
        for r in order:
            if (anchor[r], i[r], j[r]) != group:
                group, grown, waiting, at = (anchor[r], i[r], j[r]), Automaton(), [], None
            if doc[r] != at:  # what the documents before have is known from here on
                for earlier in waiting:
                    grown.add(earlier)
                waiting, at = [], doc[r]
            sequence = text[r].split(b" ")
            ranges = grown.matches(sequence, window) if len(grown.next) > 1 else []
            out += [(anchor[r], span[r], lo - lead[r], hi - lead[r]) for lo, hi in ranges]
            # Merged matches of several spans may cover a span that none of them holds; windows across them begin in it.
            if ranges != [(0, len(sequence))] or not grown.holds(sequence):
                waiting.append(sequence)
        a = list(zip(*out)) or [[]] * 4
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("anchor", "span", "lo", "hi"), a, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))})

    # Spans are few bytes and much work, so the number of tasks goes by spans, not by bytes.
    grouped = dealt.select(several.alias("g"), "anchor", "i", "j", "span", "doc_id", "lead", "words").repartition(int(tasks), "g").groupBy("g")
    return grouped.applyInArrow(stream, "anchor bigint, span bigint, lo int, hi int")


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tag, ``ranges``: word ranges (lo, hi) covered by windows that begin in a document with a smaller id."""
    if window != WINDOW:
        raise ValueError(f"anchors are made for windows of {WINDOW} words")
    marked = common.written(_occurrences(docs), "anchors")
    shared = marked.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    # Written before it is joined: then both sides of the join are plain shuffles, and adaptive execution splits a hot anchor.
    held = common.written(marked.join(common.written(shared, "shared-anchors"), "anchor"), "shared")
    # One row per distinct span of an anchor, at its first document; copies collapse before the shuffle.
    firsts = common.written(held.groupBy("anchor", "span").agg(F.min(F.struct("doc_id", "tag", "pos")).alias("f")).select("anchor", "span", "f.*"), "firsts")
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("n > 1 and lo < hi")
    mixed = common.written(firsts.join(common.written(several.select("anchor"), "several"), "anchor"), "mixed")
    matched = common.written(_matched(_spans_of(mixed, docs), mixed, window), "matched")
    first_doc = firsts.select("anchor", "span", F.col("doc_id").alias("first_doc"))
    held = held.join(first_doc, ["anchor", "span"])
    copied = held.filter(F.col("doc_id") > F.col("first_doc")).select(
        "doc_id", "tag", F.greatest(F.col("pos") + (GRAM - WINDOW), F.lit(0)).alias("lo"), (F.col("pos") + WINDOW).alias("hi")
    )
    own = (
        held.filter(F.col("doc_id") == F.col("first_doc"))
        .join(matched, ["anchor", "span"])
        .select("doc_id", "tag", (F.col("pos") + F.col("lo")).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi"))
    )
    ranges = copied.unionByName(own)
    return ranges.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def _removed(n: int, ranges: Iterable[dict] | None) -> np.ndarray:
    """Which of ``n`` words lie in a range; a range may end past the text, where a copy's span does."""
    step = np.zeros(n + 1, np.int32)
    for r in ranges or ():
        step[r["lo"]] += 1
        step[min(r["hi"], n)] -= 1
    return np.cumsum(step[:-1]) > 0


def _with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    tag = F.xxhash64(docs["text"])
    found = ranges.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("ranges").alias("__ranges"))
    return docs.join(found, (docs["doc_id"].cast("bigint") == found["__id"]) & (tag == found["__tag"]), "left").drop("__id", "__tag")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    rows = _with_ranges(docs.select("doc_id", "text"), repeated_ranges(docs))

    def digest(batches):
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = _split(text or "")
                n = len(parts)
                if ranges:
                    gone = _removed(n, ranges)
                    parts = [parts[i] for i in np.flatnonzero(~gone)]
                out.append((n, n - len(parts), hashlib.sha256(b" ".join(parts)).hexdigest()))
            a = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "__ranges")
    return rows.mapInArrow(digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with repeated words cut out of the texts, all else of the texts as it is; ``size`` follows the text."""
    columns = docs.columns

    def cut(batches):
        for batch in batches:
            out = []
            for body, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not ranges:
                    out.append(body)
                    continue
                raw = body.encode()
                data = np.frombuffer(raw, np.uint8)
                found = words(data, np.array([0, len(data)]), hashes=False)
                gone = np.flatnonzero(np.diff(np.concatenate([[0], _removed(len(found.start), ranges).astype(np.int8), [0]])))
                kept, at = [], 0
                for lo, hi in zip(gone[::2].tolist(), gone[1::2].tolist()):
                    kept.append(raw[at : found.start[lo]])
                    at = int(found.start[hi]) if hi < len(found.start) else len(raw)
                out.append((b"".join(kept) + raw[at:]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], schema)

    rows = _with_ranges(docs, repeated_ranges(docs))
    others = [c for c in columns if c != text]
    schema = [text, *others]
    kinds = dict(docs.dtypes)
    made = rows.select(text, "__ranges", *others).mapInArrow(cut, ", ".join(f"`{c}` {kinds[c]}" for c in schema))
    if size in columns:
        made = made.withColumn(size, F.length(text).cast(kinds[size]))
    return made.select(*columns)


def known_spans(docs: DataFrame, reference: Sequence[str], window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id and the word ranges that match ``reference`` texts in at least ``window`` words; a fixed, small reference only.

    The reference is cut into shards of at most ``shard_words`` words (a longer text is cut with an overlap of
    ``window`` - 1 words, which loses no window), one automaton each.
    """
    shards, room = [[]], shard_words
    for text in reference:
        parts = _split(text)
        for lo in range(0, max(len(parts) - window + 1, 0), max(shard_words - window + 1, 1)):
            piece = parts[lo : lo + shard_words]
            if len(piece) > room:
                shards.append([])
                room = shard_words
            shards[-1].append(piece)
            room -= len(piece)
    held = docs.sparkSession.sparkContext.broadcast(shards)

    def stream(batches):
        automata = []
        for shard in held.value:
            automata.append(Automaton())
            for piece in shard:
                automata[-1].add(piece)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                parts = _split(text or "")
                found = sorted(r for a in automata for r in a.matches(parts, window))
                out.append([{"lo": lo, "hi": hi} for lo, hi in found])
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "ranges"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(stream, "doc_id bigint, ranges array<struct<lo:int,hi:int>>")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLES: dict[str, str] = {}
