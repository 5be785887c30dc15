"""MinHash near-deduplication with HyperMinHash registers.

A document's set holds the distinct hashes of its k-word shingles (A-Z lower-cased); a shorter text is one
shingle.  Each of ``BUCKETS`` buckets keeps, of its smallest hash, the number of
leading zeros and ``MANTISSA`` further bits; empty buckets borrow from others by a fixed
probing order.  Documents with equal sets are one class at once, by a digest.

Between class representatives, bands of ``ROWS`` registers give buckets of candidates.
Links are needed only to join components, so no bucket is expanded into all its pairs at once:

1. star rounds: a bucket's members are compared with one member each round, chosen by a hash;
2. buckets that still hold several components are compared exhaustively between
   components, in blocks of bounded size.

A candidate pair passes the size bound, then the collision-corrected estimate from registers
less ``SIGMAS`` standard errors, then the exact comparison of full sets.

Edge cases: a null text or one without words has an empty set, no links, and is its own
component.  Rows that share a doc_id are one vertex; a null doc_id has no links, a null
component and is not kept.  A very long text is one set, whole; equal sets tie to the smallest id.  An empty table gives
no rows; other columns are not read, and ``keep_one`` keeps them whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.graph import components
from millrace.llm.words import lowered, mix, windows, words

BUCKETS, MANTISSA, ROWS = 128, 10, 4
BANDS = BUCKETS // ROWS
SIGMAS = 4.5
STAR_ROUNDS = 2
#: Documents of a block in the exhaustive comparison; a task holds two blocks.
BLOCK = 256
_EMPTY = np.uint16(0xFFFF)
_PROBES = np.random.default_rng(31).integers(0, BUCKETS, (48, BUCKETS))
#: Chance that two registers agree though their hashes differ: equal zeros (sum of 4^-k) and equal mantissas.
COLLISION = 2.0**-MANTISSA / 3


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data, offsets = common.text_buffers(column)
    out: list[np.ndarray] = []
    for lo, hi in common.slices(offsets):
        found = words(lowered(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo])
        value, at = windows(found.hash, found.first, k)
        edge = np.searchsorted(at, found.first).tolist()
        first = found.first.tolist()
        for i in range(hi - lo):
            n = first[i + 1] - first[i]
            if n >= k:
                out.append(np.unique(value[edge[i] : edge[i + 1]]))
            elif n:
                few = found.hash[first[i] : first[i + 1]]
                out.append(mix(np.bitwise_xor.reduce(mix(few + np.arange(1, n + 1, dtype=np.uint64)))[None] + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row a set; rows of empty sets are all empty."""
    out = np.full((len(sets), BUCKETS), _EMPTY, np.uint16)
    size = np.array([len(s) for s in sets], np.int64)
    if size.sum() == 0:
        return out
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    bits = BUCKETS.bit_length() - 1
    bucket = (flat >> np.uint64(64 - bits)).astype(np.int64)
    cell = row * BUCKETS + bucket
    least = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))  # sets are sorted: the first of a cell is its least
    rest = flat[least] << np.uint64(bits) | np.uint64(1)
    zeros = np.zeros(len(rest), np.uint64)
    probe = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = probe < np.uint64(1) << np.uint64(64 - step)
        zeros[small] += np.uint64(step)
        probe[small] <<= np.uint64(step)
    mantissa = probe << np.uint64(1) >> np.uint64(64 - MANTISSA)
    out.ravel()[cell[least]] = (np.minimum(zeros, 62).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    _fill(out, size > 0)
    return out


def _fill(out: np.ndarray, some: np.ndarray) -> None:
    """Give empty registers of non-empty sets the value of another, probing in an order that is the same for all sets."""
    own = out.copy()
    need_row, need_col = np.nonzero((own == _EMPTY) & some[:, None])
    for probe in _PROBES:
        if not len(need_row):
            return
        value = own[need_row, probe[need_col]]
        out[need_row, need_col] = value
        left = value == _EMPTY
        need_row, need_col = need_row[left], need_col[left]
    for step in range(1, BUCKETS):
        if not len(need_row):
            return
        value = own[need_row, (need_col + step) % BUCKETS]
        out[need_row, need_col] = value
        left = value == _EMPTY
        need_row, need_col = need_row[left], need_col[left]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and registers (null for an empty set)."""

    def sign(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), k)
            for lo in range(0, max(len(sets), 1), 2048):
                some = sets[lo : lo + 2048]
                rows = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), r.tobytes()) if len(s) else (None, None) for s, r in zip(some, registers(some))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(some)),
                        pa.array([len(s) for s in some], pa.int64()),
                        pa.array([r[0] for r in rows], pa.binary()),
                        pa.array([r[1] for r in rows], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "registers"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(sign, "doc_id bigint, n_shingles bigint, digest binary, registers binary")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, corrected for chance agreement."""
    share = (a == b).mean(axis=-1)
    return np.clip((share - COLLISION) / (1 - COLLISION), 0, 1)


def _floor(n: np.ndarray, least: float) -> np.ndarray:
    """The estimate below which a pair of sets, the smaller of ``n`` elements, cannot reach ``least`` but by rare chance."""
    seen = np.minimum(n, BUCKETS * (1 - np.exp(-n / BUCKETS)) + 1)
    return least - SIGMAS * np.sqrt(least * (1 - least) / np.maximum(seen, 1)) - 1 / np.maximum(seen, 1)


def _fits(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose registers let them reach ``percent``."""
    a = nodes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    b = nodes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))

    def judge(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in (4, 5))
                least = np.minimum(batch.column(2).to_numpy(), batch.column(3).to_numpy()).astype(float)
                keep = estimate(x, y) >= _floor(least, percent / 100)
                yield batch.select([0, 1]).filter(pa.array(keep))

    joined = pairs.join(a, "a").join(b, "b").filter(_fits("n_a", "n_b", percent))
    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(judge, "a bigint, b bigint").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach ``percent``, compared exactly."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("t_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("t_b"))

    def judge(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            _, offsets = common.text_buffers(batch.column(2))
            _, other = common.text_buffers(batch.column(3))
            for lo, hi in common.slices(offsets + other):
                x, y = (shingle_sets(batch.column(c).slice(lo, hi - lo), k) for c in (2, 3))
                for i, (s, t) in enumerate(zip(x, y)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep[lo + i] = both > 0 and 100 * both >= percent * (len(s) + len(t) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "t_a", "t_b").mapInArrow(judge, "a bigint, b bigint").distinct()


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, n, label of every node."""
    found = components(links)
    return nodes.join(found, "id", "left").select("id", "n", F.coalesce("label", "id").alias("label"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = common.written(signatures(docs, k), "signatures")
    full = signed.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # Written before it is joined: then both sides of the join are plain shuffles, and adaptive execution splits a hot digest.
    classes = common.written(full.groupBy("digest").agg(F.min("doc_id").alias("class")), "classes")
    # Every row with its class; the registers stay with the row that stands for the class.
    members = common.written(
        signed.join(classes, "digest", "left").select(
            "doc_id", "n_shingles", "digest", "class", F.when(F.col("doc_id") == F.col("class"), F.col("registers")).alias("registers")
        ),
        "members",
    )
    nodes = common.written(
        members.filter("registers IS NOT NULL").dropDuplicates(["digest"]).select(F.col("class").alias("id"), F.col("n_shingles").cast("int").alias("n"), "registers"),
        "nodes",
    )
    band = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    )
    bands = nodes.select("id", "n", F.explode(band).alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("__n")).filter("size > 1").select("key", "size")
    shared = common.written(shared, "shared-keys")
    bands = common.written(bands.join(shared, "key"), "bands")
    texts = common.written(
        docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(bands.select("id").distinct(), "id"), "texts"
    )
    # An id with two sets joins their classes.
    twice = members.filter("class IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a != z")
    links = members.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("class").alias("b"))
    labelled = nodes.select("id", "n", F.col("id").alias("label"))
    open_bands, done, found = bands, None, None
    for turn in range(STAR_ROUNDS):
        seat = F.xxhash64(F.lit(turn), "id") if turn else F.col("id")
        pivot = common.written(open_bands.groupBy("key").agg(F.min_by(F.struct("id", "n"), seat).alias("p")), "pivots")
        pairs = (
            open_bands.join(pivot, "key")
            .filter((F.col("id") != F.col("p.id")) & (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")))
            .select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
            .distinct()
        )
        if done is not None:
            old = labelled.select("id", "label")
            pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = pairs.join(old.toDF("a", "l_a"), "a").join(old.toDF("b", "l_b"), "b").filter("l_a != l_b").select("a", "b")
        pairs = common.written(pairs, "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        new = _confirmed(_estimated(pairs, nodes, percent), texts, k, percent)
        found = common.written(new if found is None else found.unionByName(new), "found")
        labelled = common.written(_labelled(nodes, found), "labelled")
        open_bands = common.written(_open(bands, labelled), "open")
        if not open_bands.limit(1).count():
            break
    else:
        found = found.unionByName(common.written(_between(open_bands, texts, k, percent), "between"))
    labels = components(found.unionByName(links)).withColumnRenamed("id", "class")
    out = members.join(labels, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def _open(bands: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components and were not compared in full, one bucket of each set of members."""
    rows = bands.filter("size > 2").join(labelled.select("id", "label"), "id")
    mixed = (
        rows.groupBy("key")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"))
        .filter("lo != hi")
        .groupBy("c", "s")
        .agg(F.min("key").alias("key"))
        .select("key")
    )
    return rows.join(mixed, "key").select("key", "id", "n", "label", "size")


def _between(rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (by label) between different components among documents that open buckets connect.

    Documents connected by open buckets form a family.  A family is dealt into blocks of about
    ``BLOCK`` documents and every pair of blocks is a group of its own, so a task holds two blocks
    however large the family is.  All pairs of a group are compared exactly by one product of
    0/1 matrices over the shingles that two of its documents share; what leaves a group is one link for
    each pair of components, not the pairs.
    """
    ids = rows.select("id", "label").distinct()
    stars = rows.groupBy("key").agg(F.min("id").alias("a")).join(rows.select("key", F.col("id").alias("b")), "key").filter("a != b")
    family = components(stars.select("a", "b").distinct()).select("id", F.col("label").alias("family"))
    member = common.written(ids.join(family, "id"), "family")
    size = member.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = member.join(size, "family").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.join(texts, "id").select(
        "family", "id", "label", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    dealt = dealt.select("family", "id", "label", "text", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(key, table):
        label, own = table.column("label").to_numpy(), table.column("own").to_numpy()
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if len(label) < 2 or (label == label[0]).all():
            return none
        sets = shingle_sets(table.column("text").combine_chunks(), k)
        size = np.array([len(s) for s in sets], np.float32)
        value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        common_to = times[column] > 1
        row, column = row[common_to], (np.cumsum(times > 1) - 1)[column[common_to]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = int((times > 1).sum())
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, width, 4096):  # bounds the matrices
            a, b = np.searchsorted(column, (lo, lo + 4096))
            part = np.zeros((len(sets), min(4096, width - lo)), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            both += part @ part.T
        x, y = key[1].as_py(), key[2].as_py()
        asked = (own == x)[:, None] & (own == y)[None, :] & (label[:, None] != label[None, :])
        linked = asked & (both > 0) & (100 * both.astype(np.float64) >= percent * (size[:, None] + size[None, :] - both).astype(np.float64))
        a, b = np.nonzero(linked)
        pairs = np.unique(np.stack([np.minimum(label[a], label[b]), np.maximum(label[a], label[b])]), axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return dealt.groupBy("family", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but those of documents that are near copies of a document with a smaller id.

    Of rows that share an id, one with the least hash of the text stays.  Rows without an id have no component and
    all stay, copies or not.
    """
    found = near_duplicates(docs, k, percent)
    dropped = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id")).distinct()
    left = docs.join(dropped, docs["doc_id"] == dropped["__id"], "left_anti")
    # Rows without an id are told apart by a number, so that they are neither ranked together nor dropped.
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    order = Window.partitionBy("__key").orderBy(F.xxhash64("text"), "text")
    return left.withColumn("__key", key).withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(*docs.columns)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), k=3, percent=85)


QUERIES = {"op2_minhash_dedup": op2_minhash_dedup}
ORACLES: dict[str, str] = {}
