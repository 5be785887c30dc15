"""Document fingerprints: 64-bit SimHash, and search by permuted block tables.

Terms are words (weight: their length in bytes, at most ``WORD_MOST``) and pairs of
neighbouring words (weight ``PAIR_WEIGHT``), A-Z lower-cased.  Every occurrence of a term votes with its
weight for or against each bit by the bits of its hash; a bit is set if the votes are above zero.

Search finds all fingerprints within ``radius`` bits: the 64 bits fall into ``blocks``
blocks, and two fingerprints within the radius agree in at least ``blocks - radius`` of them.
One table a choice of that many blocks, keyed by the agreeing bits put to the front, thus
meets every pair; a table's candidates are confirmed by counting differing bits.

Edge cases: a null or empty text has fingerprint 0 and is its own edit if the next text is
too short to give anything.  Rows are ordered by doc_id, nulls first, equal keys by their texts;
after the last comes the first, so a single row is its own next.  An empty table gives no rows.
A very long text is voted on in whole, words over word; equal texts have equal fingerprints; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.words import lowered, mix, words

WORD_MOST, PAIR_WEIGHT = 8, 12
BITS = 64


def simhash(column: pa.Array) -> np.ndarray:
    """Fingerprints (uint64) of a column of texts."""
    data, offsets = common.text_buffers(column)
    out = np.zeros(len(column), np.uint64)
    for lo, hi in common.slices(offsets, 1 << 18):
        part = lowered(data[offsets[lo] : offsets[hi]])
        found = words(part, offsets[lo : hi + 1] - offsets[lo])
        if not len(found.hash):
            continue
        row = found.row
        pairs = mix(found.hash[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + found.hash[1:] * np.uint64(0x165667B19E3779F9))
        pairs = pairs[row[1:] == row[:-1]]
        size = np.minimum(found.end - found.start, WORD_MOST)
        has = np.flatnonzero(np.diff(found.first))
        votes = _votes(found.hash, size, found.first[:-1][has])
        begin = found.first - np.concatenate([[0], np.cumsum(np.diff(found.first) > 0)])
        many = has[np.diff(found.first)[has] > 1]
        if len(many):
            votes[np.searchsorted(has, many)] += PAIR_WEIGHT * _votes(pairs, None, begin[:-1][many])
        bits = np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()
        out[lo + has] = bits
    return out


def _votes(hashes: np.ndarray, weight: np.ndarray | None, begin: np.ndarray) -> np.ndarray:
    """Weighted votes by row (64 columns); ``begin``: where each row starts.

    Set bits are counted in byte-wide lanes, eight lanes a machine word, over runs so short
    that no lane overflows; the runs of a row are then added up.  Votes against are what is left of the weight.
    """
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    most = 1
    if weight is not None:
        lanes *= weight.astype(np.uint64)[:, None]
        most = WORD_MOST
    n, run = len(hashes), 255 // most
    size = np.diff(np.append(begin, n))
    runs = -(-size // run)
    first = np.cumsum(runs) - runs
    cut = np.repeat(begin - first * run, runs) + np.arange(runs.sum()) * run
    short = np.add.reduceat(lanes, cut, axis=0).view(np.uint8)
    found = np.add.reduceat(short, first, axis=0, dtype=np.int64)
    total = size if weight is None else np.add.reduceat(weight.astype(np.int64), begin)
    return 2 * found - total[:, None]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1.0 - np.bitwise_count(a ^ b) / BITS


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _rows(ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    """Result rows for texts whose next texts are known; ``own``, ``after``: fingerprints of both."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    new = _hashed(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([f"{x:016x}" for x in own.tolist()], pa.string()),
            pa.array([f"{x:016x}" for x in new.tolist()], pa.string()),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, after)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _hashed(texts: list[str]) -> np.ndarray:
    return simhash(pa.array(texts, pa.large_string()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint, that of its edited text, and likeness to edit and next document.

    One shuffle, a range sort by doc_id.  Every partition works through its rows in order and
    leaves out its last one, which lacks a next text; those few edge rows, one a partition, are
    matched with the first row of the next partition.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())

    def work(batches):
        first = last = None
        part = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            _, offsets = common.text_buffers(texts)
            for lo, hi in common.slices(offsets):
                some = texts[lo:hi].to_pylist()
                key = ids[lo:hi]
                own = simhash(texts.slice(lo, hi - lo))
                if first is None:
                    first, part = (key[0], some[0]), batch.column(2)[0].as_py()
                if last is not None:
                    key, some, own = [last[0], *key], [last[1], *some], np.append(last[2], own)
                last = (key[-1], some[-1], own[-1])
                if len(key) > 1:
                    made = _rows(key[:-1], some[:-1], some[1:], own[:-1], own[1:])
                    none = pa.nulls(made.num_rows, pa.string())
                    yield _with_edges(made, pa.nulls(made.num_rows, pa.int32()), none, none)
        if first is not None:
            empty = pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in _ARROW], schema=_ARROW)
            empty = empty.set_column(0, _ARROW.field(0), pa.array([last[0]], pa.int64()))
            yield _with_edges(empty, pa.array([part], pa.int32()), pa.array([first[1]], pa.string()), pa.array([last[1]], pa.string()))

    both = common.written(ordered.mapInArrow(work, f"{_SCHEMA}, part int, first_text string, last_text string"), "fingerprints")
    edges = both.filter(F.col("part").isNotNull()).select("part", "doc_id", "first_text", "last_text")
    # One number a partition goes to the driver, the texts do not.
    numbers = sorted(r["part"] for r in edges.select("part").collect())
    following = spark.createDataFrame([(p, q) for p, q in zip(numbers, numbers[1:] + numbers[:1])], "part int, following int")
    pairs = edges.join(F.broadcast(following), "part").join(
        edges.select(F.col("part").alias("following"), F.col("first_text").alias("next_text")), "following"
    )

    def finish(batches):
        for batch in batches:
            if batch.num_rows:
                ids, texts, following = (c.to_pylist() for c in batch.columns)
                yield _rows(ids, texts, following, _hashed(texts), _hashed(following))

    return (
        both.filter(F.col("part").isNull())
        .drop("part", "first_text", "last_text")
        .unionByName(pairs.select("doc_id", "last_text", "next_text").mapInArrow(finish, _SCHEMA))
    )


_ARROW = _rows([], [], [], np.zeros(0, np.uint64), np.zeros(0, np.uint64)).schema


def _with_edges(batch: pa.RecordBatch, part, first, last) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, part, first, last], [*batch.schema.names, "part", "first_text", "last_text"])


def _block_masks(blocks: int) -> list[int]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def within_radius(found: DataFrame, asked: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Pairs (asked, found) of distinct fingerprints (bigint column ``fingerprint``) at most ``radius`` bits apart, with ``distance``.

    Both sides are made distinct first: documents that share a fingerprint are members of one
    class, and links are between classes.  A pair met in several tables is given once, by the
    first table in which it meets.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be below the number of blocks")
    masks = _block_masks(blocks)
    tables = [_signed(sum(masks[i] for i in choice)) for choice in combinations(range(blocks), blocks - radius)]

    def tabled(rows: DataFrame, name: str) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(t).alias("table"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)))
        return rows.select(F.col("fingerprint").alias(name)).distinct().select(name, F.explode(keys).alias("at")).select(name, "at.table", "at.key")

    a, b = F.col("asked"), F.col("found")
    apart = a.bitwiseXOR(b)
    meets = [F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(tables)]
    pairs = tabled(asked, "asked").join(tabled(found, "found"), ["table", "key"])
    return pairs.filter((F.bit_count(apart) <= radius) & (F.col("table") == F.coalesce(*meets)) & (a != b)).select(
        "asked", "found", F.bit_count(apart).alias("distance")
    )


#: Bits within which the query looks for other fingerprints, for rows whose id is divisible by ASKED.
RADIUS, ASKED = 3, 50


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then ``n_near``: for rows whose id is divisible by 50, other distinct fingerprints within 3 bits (else null)."""
    rows = common.written(fingerprints(common.documents(spark, sf_dir)), "op3")
    whole = F.conv("fingerprint", 16, -10).cast("bigint")
    asked = rows.filter(F.col("doc_id") % ASKED == 0)
    links = within_radius(rows.select(whole.alias("fingerprint")), asked.select(whole.alias("fingerprint")), RADIUS)
    near = links.groupBy("asked").agg(F.count(F.lit(1)).alias("n"))
    counted = asked.join(near, whole == near["asked"], "left").select(asked["*"], F.coalesce("n", F.lit(0)).alias("n_near"))
    others = rows.filter(F.coalesce(F.col("doc_id") % ASKED != 0, F.lit(True))).withColumn("n_near", F.lit(None).cast("bigint"))
    return others.unionByName(counted)


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
