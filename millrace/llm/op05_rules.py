"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

For each length the hashes of all n-word windows of a text are compared; a window that
occurs twice or more marks all its words, the first occurrence included.  The verdict
looks at the share of word characters (code points) inside marked windows, and at the
share inside lines that repeat an earlier line.

Edge cases: a null or empty text has no words, fails the base rule and is not kept.
Repeated rows are judged each by itself, equal texts alike; a very long text is judged in whole.  Extra columns are carried or
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common
from millrace.llm.words import SPACE_STR, per_row, windows, words

#: n-gram length -> largest share of word characters that duplicated n-grams may cover.
LIMITS = {5: 0.40, 8: 0.40, 12: 0.40}
#: Largest share of word characters in lines equal to an earlier line.
LINE_LIMIT = 0.35
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
BASE_WINDOW = 8
BASE_PERCENT = 30

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_line_share double, " + ", ".join(f"dup_{n}gram_share double" for n in LIMITS)
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _covered(marked: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside windows of ``n`` words that begin at ``marked``."""
    step = np.zeros(total + 1, np.int32)
    step[marked] += 1
    step[marked + n] -= 1
    return np.cumsum(step[:-1]) > 0


def _repeated(found, n: int, row: np.ndarray, among: np.ndarray | None) -> np.ndarray:
    """Window starts whose n words occur at least twice in their row; ``among``: the starts to look at."""
    value, at = windows(found.hash, found.first, n)
    if among is not None:
        keep = among[at]
        value, at = value[keep], at[keep]
    value = value ^ (row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(value)
    same = value[order[1:]] == value[order[:-1]]
    twice = np.zeros(len(value), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return at[twice]


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """The columns of ``SCHEMA`` but ``doc_id``, for a column of texts."""
    parts = []
    data, offsets = common.text_buffers(column)
    for lo, hi in common.slices(offsets):
        part = column.slice(lo, hi - lo)
        parts.append(_measures(part, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
    if not parts:
        parts = [_measures(column, data, offsets)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _measures(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    found = words(data, offsets)
    total, row = len(found.hash), found.row
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = lead[found.end] - lead[found.start]
    n_words = np.diff(found.first)
    word_chars = per_row(chars, found.first)
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": per_row(_SYMBOL[data], offsets),
    }
    lines, line_chars = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            seen: set[str] = set()
            for line in text.split("\n"):
                if line in seen:
                    lines[i] += 1
                    line_chars[i] += sum(map(len, line.translate(_BLANK).split(" ")))
                elif line.strip(SPACE_STR):
                    seen.add(line)
    out["n_dup_lines"] = lines
    # A longer window that occurs twice begins with a shorter one that does.
    among, shares = None, {}
    for n in sorted({*LIMITS, BASE_WINDOW}):
        at = _repeated(found, n, row, among)
        among = np.zeros(total, bool)
        among[at] = True
        inside = _covered(at, n, total)
        if n in LIMITS:
            shares[n] = per_row(chars * inside, found.first) / np.maximum(word_chars, 1)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_row(inside, found.first)
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * n_words)
    out["dup_line_share"] = line_chars / np.maximum(word_chars, 1)
    out["kept"] = ~out["base_failed"] & (out["dup_line_share"] <= LINE_LIMIT)
    for n, share in shares.items():
        out["kept"] &= share <= LIMITS[n]
        out[f"dup_{n}gram_share"] = share
    return out


_BLANK = str.maketrans(dict.fromkeys(SPACE_STR, " "))


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its counts, coverage shares and verdict.  No shuffle."""

    def score(batches):
        for batch in batches:
            found = measures(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k]) for k in names)], ["doc_id", *names])

    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text")).mapInArrow(score, SCHEMA)


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all columns as they are."""
    at = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pc.fill_null(pa.array(measures(batch.column(at))["kept"]), False))

    return docs.mapInArrow(keep, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(common.documents(spark, sf_dir))


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
