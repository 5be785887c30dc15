"""SentencePiece encoding and decoding; giant texts by a max-plus parallel scan.

A sequence of pieces is the model's encoding of a text exactly if every two neighbours are:
encoding the two together gives the same two back.  So the encoding is the best path
through the lattice of pieces, where an edge between neighbours weighs 0 if they agree and
minus infinity if not.  A giant text is cut into chunks.  For a chunk, every piece that may
hold the last character before the cut is an entry state, likewise at its end an exit state, and a
max-plus matrix says which exits an entry reaches (finite weights are all 0, so rows
are kept as bit sets and max-plus products become unions).  Matrices of neighbouring
chunks combine associatively; a tree scan over them gives each chunk its one entry and exit, and
every chunk traces its own pieces back, independent of the others.

Other texts are encoded unit by unit (see ``spm``).  Decoding puts piece bytes together.

Edge cases: a null or empty text has no ids and decodes to the empty text.  U+2581 in a text is the library's
own mark of a blank: it is encoded like one and decodes to one; ``round_trip`` tells.  Repeated rows and ids are encoded
each; an empty table gives no rows; columns that the result names itself are replaced, others kept or not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.spm import BLANK, Memory, Pieces

MODEL = "piece_bpe_32k.model"
#: Characters from which a text is giant, and of a chunk.
GIANT, CHUNK = 65_536, 8_192
#: Matrices that a task of the scan combines; most states at a cut (bits of a packed row).
FAN, STATES = 256, 256


class Lattice:
    """Agreement of neighbouring pieces of a model, remembered."""

    _loaded: dict[str, "Lattice"] = {}

    @classmethod
    def at(cls, path: str) -> "Lattice":
        if path not in cls._loaded:
            cls._loaded[path] = cls(Pieces.at(path))
        return cls._loaded[path]

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.agrees = Memory(self._agrees)
        self.whole = Memory(lambda piece: self._merge(piece) == [piece])
        # A character outside the vocabulary stands for itself; it never merges.
        self.known = pieces.ids

    def _merge(self, text: str) -> list[str]:
        """The model's own merges on a short text: best score first, leftmost on ties."""
        parts, score = list(text), self.pieces.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _agrees(self, pair: tuple[str, str]) -> bool:
        a, b = pair
        if not (self.whole[a] and self.whole[b]):
            return False
        if a[-1] + b[0] not in self.pieces.pairs:
            return True
        if a + b in self.known:  # the two would be merged
            return False
        return self._merge(a + b) == [a, b]

    def pieces_at(self, text: str, end: int) -> list[str]:
        """Pieces of ``text`` that end at ``end``."""
        known = self.known
        out = [text[end - k : end] for k in range(min(self.pieces.longest, end), 1, -1) if text[end - k : end] in known]
        return [*out, text[end - 1]]

    def covering(self, text: str, cut: int) -> list[tuple[int, int]]:
        """States at a cut: (start, end) of every piece that holds the character before it."""
        if cut == 0:
            return [(0, 0)]
        if cut == len(text):
            return [(cut - len(p), cut) for p in self.pieces_at(text, cut)]
        most = self.pieces.longest
        found = [
            (a, b)
            for a in range(max(0, cut - most), cut)
            for b in range(cut, min(len(text), a + most) + 1)
            if text[a:b] in self.known or b - a == 1
        ]
        return found

    def matrix(self, text: str, cut: int, stop: int) -> list[int]:
        """For every exit state at ``stop`` the bit set of entry states at ``cut`` that reach it."""
        return self._run(text, self.covering(text, cut), cut, stop)[0]

    def _run(self, text: str, entries: list[tuple[int, int]], cut: int, stop: int):
        exits = self.covering(text, stop)
        wanted = set(exits)
        # Bit sets of entries by end, then start, of each piece.
        reached: dict[int, dict[int, int]] = {}
        for k, (a, b) in enumerate(entries):
            reached.setdefault(b, {})[a] = 1 << k
        at, last = min(b for _, b in entries), max(b for _, b in exits)
        agrees, back = self.agrees, {}
        for end in range(at + 1, last + 1):
            here = reached.setdefault(end, {})
            for piece in self.pieces_at(text, end):
                start = end - len(piece)
                # Only pieces after an entry, and of those past the stop only exits.
                if start < at or start >= stop or (end > stop and (start, end) not in wanted):
                    continue
                mask, came = 0, []
                for before, bits in reached.get(start, {}).items():
                    if start == 0 or before == start:  # the text's beginning agrees with any piece that is whole
                        good = self.whole[piece]
                    else:
                        good = agrees[(text[before:start], piece)]
                    if good and bits:
                        mask |= bits
                        came.append((before, bits))
                if mask:
                    here[start] = here.get(start, 0) | mask
                    back[(start, end)] = came
        rows = [reached.get(b, {}).get(a, 0) for a, b in exits]
        return rows, exits, back

    def trace(self, text: str, cut: int, stop: int, entry: int, exit_: int) -> list[tuple[int, int]]:
        """The pieces after the entry state up to and with the exit state."""
        entries = [self.covering(text, cut)[entry]]
        _, exits, back = self._run(text, entries, cut, stop)
        at, out = exits[exit_], []
        while at != entries[0]:
            out.append(at)
            start = at[0]
            before = back[at][0][0]
            at = (before, start)
        return out[::-1]

    def ids(self, text: str, spans: Iterable[tuple[int, int]]) -> list[int]:
        out = []
        for a, b in spans:
            found = self.known.get(text[a:b])
            out += [found] if found is not None else [self.pieces.byte_id[x] for x in text[a:b].encode()]
        return out


def combined(first: list[int], second: list[int]) -> list[int]:
    """Max-plus product of two matrices kept as bit sets: exits of ``second`` by entries of ``first``."""
    out = []
    for row in second:
        mask = 0
        while row:
            low = row & -row
            mask |= first[low.bit_length() - 1]
            row ^= low
        out.append(mask)
    return out


def resolved(matrices: list[list[int]], entry: int = 0, exit_: int | None = None) -> list[tuple[int, int]]:
    """Entry and exit state of every chunk between ``entry`` and ``exit_`` (None: the only one reached): prefix products forward, then the only way back."""
    ahead = [[int(k == entry) for k in range(STATES)]]
    for m in matrices:
        ahead.append(combined(ahead[-1], m))
    if exit_ is None:
        ends = [k for k, row in enumerate(ahead[-1]) if row]
        if len(ends) != 1:
            raise ValueError("a text has one encoding")
        exit_ = ends[0]
    out, at = [], exit_
    for m, before in zip(reversed(matrices), reversed(ahead[:-1])):
        ways = [k for k in range(m[at].bit_length()) if m[at] >> k & 1 and before[k]]
        if len(ways) != 1:
            raise ValueError("a text has one encoding")
        out.append((ways[0], at))
        at = ways[0]
    return out[::-1]


def product(matrices: list[list[int]]) -> list[int]:
    """The matrix of neighbouring chunks together, combined pair by pair."""
    while len(matrices) > 1:
        matrices = [combined(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def _packed(matrix: list[int]) -> bytes:
    return b"".join(row.to_bytes(STATES // 8, "little") for row in matrix)


def _matrix(packed: bytes) -> list[int]:
    return [int.from_bytes(packed[p : p + STATES // 8], "little") for p in range(0, len(packed), STATES // 8)]


def _cuts(n: int, chunk: int) -> list[int]:
    return [*range(0, n, chunk), n]


def scan_encode(path: str, text: str, chunk: int = CHUNK) -> list[int]:
    """Ids of one text by the scan, chunk after chunk in this process."""
    if not text:
        return []
    lattice, marked = Lattice.at(path), BLANK + text.replace(" ", BLANK)
    cuts = _cuts(len(marked), chunk)
    ways = resolved([lattice.matrix(marked, a, b) for a, b in zip(cuts, cuts[1:])])
    return [i for (a, b), (x, y) in zip(zip(cuts, cuts[1:]), ways) for i in lattice.ids(marked, lattice.trace(marked, a, b, x, y))]


def _giants(docs: DataFrame, path: str | None, chunk: int) -> DataFrame:
    """__row and ids (2 bytes each) of giant texts: chunks are rows of their own in every step but the scan."""
    edge = 64  # characters around a chunk that its states may touch; more than the longest piece

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marked = BLANK + text.replace(" ", BLANK)
                cuts = _cuts(len(marked), chunk)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    lo = max(0, a - edge)
                    yield pa.RecordBatch.from_pydict(
                        {"__row": [row], "k": pa.array([k], pa.int32()), "piece": [marked[lo : b + edge]], "a": pa.array([a - lo], pa.int32()), "b": pa.array([b - lo], pa.int32())}
                    )

    def measure(batches):
        lattice = Lattice.at(path or _default())
        for batch in batches:
            made = [_packed(lattice.matrix(t, a, b)) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("piece", "a", "b")))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["__row", "k", "matrix"])

    def trace(batches):
        lattice = Lattice.at(path or _default())
        for batch in batches:
            out = []
            for t, a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("piece", "a", "b", "x", "y"))):
                out.append(np.array(lattice.ids(t, lattice.trace(t, a, b, x, y)), np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("k"), pa.array(out, pa.binary())], ["__row", "k", "part"])

    chunks = docs.select("__row", "text").mapInArrow(cut, "__row bigint, k int, piece string, a int, b int")
    # Chunks are few bytes and much work: they are dealt out by number, not by size, and by a key that no join has dealt them by.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.xxhash64(F.lit("chunk"), "__row", "k")
    chunks = common.written(chunks, "chunks")
    matrices = common.written(chunks.repartition(parts, dealt).mapInArrow(measure, "__row bigint, k int, matrix binary"), "matrices")
    known = chunks.join(_ways(matrices), ["__row", "k"]).select("__row", "k", "piece", "a", "b", "x", "y")
    traced = known.repartition(parts, dealt).mapInArrow(trace, "__row bigint, k int, part binary")
    parts = traced.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"))
    return parts.select("__row", F.expr("aggregate(parts, cast('' as binary), (whole, p) -> concat(whole, p.part))").alias("ids"))


def _ways(matrices: DataFrame, fan: int | None = None) -> DataFrame:
    """__row, k, x, y: entry and exit state of every chunk, by a tree scan over (__row, k, matrix).

    Up the tree, ``fan`` neighbouring matrices at a time are combined to one; the top gives each text its one way, and down the
    tree each group resolves its members between its own entry and exit.  A task holds ``fan`` matrices however long a text is.
    """
    fan = fan or FAN
    up = F.floor(F.col("k") / fan).cast("int")

    def combine(table):
        order = np.argsort(table.column("k").to_numpy())
        whole = product([_matrix(table.column("matrix")[int(i)].as_py()) for i in order])
        return pa.table({"__row": table.column("__row")[:1], "k": table.column("up")[:1], "matrix": pa.array([_packed(whole)], pa.binary())})

    def resolve(table):
        order = np.argsort(table.column("k").to_numpy())
        x, y = table.column("up_x")[0].as_py(), table.column("up_y")[0].as_py()
        ways = resolved([_matrix(table.column("matrix")[int(i)].as_py()) for i in order], x or 0, y)
        states = [pa.array([w[c] for w in ways], pa.int32()) for c in (0, 1)]
        return pa.table({"__row": table.column("__row").take(pa.array(order)), "k": table.column("k").take(pa.array(order)), "x": states[0], "y": states[1]})

    levels = [matrices]
    last = matrices.agg(F.max("k")).first()[0] or 0
    while last >= fan:
        above = levels[-1].withColumn("up", up).groupBy("__row", "up").applyInArrow(combine, "__row bigint, k int, matrix binary")
        levels.append(common.written(above, "products"))
        last //= fan
    none = F.lit(None).cast("int")
    ways = levels[-1].withColumns({"up": F.lit(0), "up_x": none, "up_y": none})
    for level in reversed(levels[:-1]):
        above = ways.groupBy("__row", "up").applyInArrow(resolve, "__row bigint, k int, x int, y int")
        above = common.written(above, "ways").select("__row", F.col("k").alias("up"), F.col("x").alias("up_x"), F.col("y").alias("up_y"))
        ways = level.withColumn("up", up).join(above, ["__row", "up"])
    return ways.groupBy("__row", "up").applyInArrow(resolve, "__row bigint, k int, x int, y int")


def _default() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _finished(docs: DataFrame, others: list[str], finish, schema: str, path: str | None, giant: int, chunk: int) -> DataFrame:
    """``finish(pieces, columns, texts, ids)`` over slices of all rows: ids of ordinary texts come unit by unit, of giant ones by the scan.

    Encoding and what is made of the ids happen in one Python call a slice.
    """
    is_giant = F.coalesce(F.length("text") >= giant, F.lit(False))

    def plain(batches):
        pieces = Pieces.at(path or _default())
        for batch in batches:
            _, offsets = common.text_buffers(batch.column(0))
            for lo, hi in common.slices(offsets):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(0).to_pylist()]
                yield finish(pieces, part.columns[1:], texts, pieces.encode(texts))

    def scanned(batches):
        pieces = Pieces.at(path or _default())
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                yield finish(pieces, part.columns[2:], part.column(0).to_pylist(), [np.frombuffer(part.column(1)[0].as_py(), np.uint16)])

    rows = docs.select("text", *others)
    small = rows.filter(~is_giant).mapInArrow(plain, schema)
    large = common.written(rows.filter(is_giant).withColumn("__row", F.monotonically_increasing_id()), "giants")
    ids = _giants(large, path, chunk).withColumnRenamed("ids", "__ids")
    return small.unionByName(large.join(ids, "__row").select("text", "__ids", *others).mapInArrow(scanned, schema))


def encoded(docs: DataFrame, path: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` plus ``ids`` (binary, 2 bytes an id, little-endian) and ``decoded``, the text of the ids; columns of these names are replaced."""
    others = [c for c in docs.columns if c not in ("ids", "decoded", "text")]
    names = [*others, "text", "ids", "decoded"]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "text string, ids binary, decoded string"])

    def finish(pieces, columns, texts, ids):
        made = [texts, [i.astype(np.uint16).tobytes() for i in ids], [pieces.decode(i) for i in ids]]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(m, k) for m, k in zip(made, (pa.string(), pa.binary(), pa.string())))], names)

    return _finished(docs, others, finish, schema, path, giant, chunk)


def _digest(pieces, columns, texts, ids):
    back = [pieces.decode(i) for i in ids]
    made = [
        pa.array([len(i) for i in ids], pa.int64()),
        pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
        pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
        pa.array([b == t for b, t in zip(back, texts)], pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays([*columns, *made], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (over 4-byte ids), decoded_sha256, round_trip."""
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"
    return _finished(docs, ["doc_id"], _digest, schema, None, GIANT, CHUNK)


def _listed(pieces, columns, texts, ids):
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32), pa.int32())
    made = [pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.array([pieces.decode(i) for i in ids], pa.string())]
    return pa.RecordBatch.from_arrays([*columns, *made], ["doc_id", "source", "n_tokens", "input_ids", "decoded"])


def with_ids(docs: DataFrame, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, n_tokens, input_ids (array of int) and the decoded text of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    schema = "doc_id bigint, source string, n_tokens bigint, input_ids array<int>, decoded string"
    return _finished(rows, ["doc_id", "source"], _listed, schema, None, giant, chunk)


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLES: dict[str, str] = {}
