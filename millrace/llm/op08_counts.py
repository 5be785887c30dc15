"""Token counts of whole texts; huge ones by overlapping chunks spliced at stable boundaries.

A huge text is encoded in chunks that overlap.  Two neighbouring encodings are spliced at
a place inside the overlap that is a token boundary in both and that is proven stable: the
characters on its two sides stand side by side in no piece of the vocabulary, so no merge
of the whole text can cross it, and both chunks see everything that matters on their
side.  If an overlap has no such place it is widened, up to the rest of the text.

Edge cases: a null or empty text has 0 bytes and 0 tokens.  Repeated rows are counted each; a null or repeated
doc_id is kept as it is.  U+2581 in a text is the library's own mark of a blank and counts as one.  Very long texts, one
unbroken word among them, are spliced like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common
from millrace.llm.spm import BLANK, Pieces

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters from which a text counts as huge, of a chunk, and of the first overlap tried.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 64

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks int, n_widened int"


def chunk_boundaries(pieces: Pieces, marked: str, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Ids and end offsets of the tokens of ``marked[lo:hi]`` (blanks marked), offsets in the whole text."""
    part = marked[lo:hi]
    # The library puts a blank in front of what it encodes; one that is there anyway is left to it.
    bare = part[0] == BLANK
    if not bare and not pieces.stable(BLANK + part, 1):
        raise ValueError("a chunk must begin where a blank in front cannot merge")
    found = pieces.library.encode((part[1:] if bare else part).replace(BLANK, " "), out_type=str)
    ids, ends, at = [], [], lo
    if not bare:
        if found[0] != BLANK:
            raise ValueError("the blank in front was merged")
        found = found[1:]
    raw = 0
    for token in found:
        if token not in pieces.ids and len(token) == 6 and token.startswith("<0x"):
            value = int(token[3:5], 16)
            ids.append(pieces.byte_id[value])
            raw += value & 0xC0 != 0x80
            at += value & 0xC0 != 0x80
            ends.append(at)
            continue
        ids.append(pieces.ids[token])
        at += len(token)
        ends.append(at)
    if at != hi:
        raise ValueError("token offsets do not cover the chunk")
    return ids, ends


def spliced(pieces: Pieces, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[list[int], int]]:
    """Ids of a text chunk by chunk up to each splice, and how often the chunk's overlap was widened; only one chunk's ids are held."""
    marked = BLANK + text.replace(" ", BLANK)
    n, lo = len(marked), 0
    starts_ok = lambda p: marked[p] == BLANK or pieces.stable(BLANK + marked[p], 1)
    while True:
        hi = min(n, lo + chunk)
        ids, ends = chunk_boundaries(pieces, marked, lo, hi)
        widened = 0
        if hi == n:
            yield ids, widened
            return
        width, cut = overlap, None
        while cut is None:
            # The next chunk begins in the overlap at some place where its start is the library's start.
            begin = max(lo + 1, hi - width)
            while begin < hi and not starts_ok(begin):
                begin += 1
            if begin < hi:
                stop = min(n, begin + 2 * width)
                _, other = chunk_boundaries(pieces, marked, begin, stop)
                mine = set(ends[bisect_left(ends, begin) :])
                both = [e for e in [begin, *other] if e in mine and begin <= e < hi and pieces.stable(marked, e) and starts_ok(e)]
                if both:
                    cut = both[-1]
            if cut is None:
                widened += 1
                if width >= hi - lo:  # nothing stable in the whole chunk: a longer chunk
                    hi = min(n, lo + 2 * (hi - lo))
                    ids, ends = chunk_boundaries(pieces, marked, lo, hi)
                    if hi == n:
                        yield ids, widened
                        return
                width = min(2 * width, hi - lo)
        # A character outside the vocabulary is several byte tokens that end at one place: all of them belong to this side.
        yield ids[: bisect_right(ends, cut)], widened
        lo = cut


def splice(pieces: Pieces, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], int, int]:
    """Ids of a text, the number of chunks and how often an overlap was widened."""
    parts = list(spliced(pieces, text, chunk, overlap))
    return [i for ids, _ in parts for i in ids], len(parts), sum(w for _, w in parts)


def count_tokens(docs: DataFrame, model: str | None = None, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """One row per document: bytes, tokens, whether over ``limit``, chunks and widenings of huge texts.  No shuffle."""

    def count(batches):
        import public_tokenizers

        pieces = Pieces.at(model or public_tokenizers.path(MODEL))
        for batch in batches:
            _, offsets = common.text_buffers(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            chunks, wider = np.ones(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for lo, hi in common.slices(offsets):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                plain = [i for i, t in enumerate(texts) if len(t) < huge]
                for i, n in zip(plain, pieces.count([texts[i] for i in plain])):
                    tokens[lo + i] = n
                for i in sorted({*range(len(texts))} - {*plain}):
                    chunks[lo + i] = 0
                    for ids, widened in spliced(pieces, texts[i], chunk, overlap):
                        tokens[lo + i] += len(ids)
                        chunks[lo + i] += 1
                        wider[lo + i] += widened
            size = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in (size, tokens, tokens > limit, chunks, wider))],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
            )

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).mapInArrow(count, SCHEMA)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
