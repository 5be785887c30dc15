"""Exact and near duplicates of pages, boilerplate, inlinks."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.shared import written

SHINGLE, MOST_WEIGHT, RADIUS, AGREE = 4, 3, 3, 3


def exact_duplicates(pages: DataFrame, digest: str, order: list) -> DataFrame:
    """Rows that share ``digest`` with an earlier row by ``order``, with that row's id as ``duplicate_of``."""
    first = pages.groupBy(digest).agg(F.min(F.struct(*order, "page_id")).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    joined = pages.join(first, digest)
    return joined.filter(F.col("page_id") != F.col("__first.page_id")).withColumn("duplicate_of", F.col("__first.page_id")).drop("__first", "__n")


def _votes(words: list[str]) -> int:
    """Signed SimHash of a text's words: shingles counted, hashed once each, bits voted by weight."""
    if not words:
        return 0
    counts = Counter(" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1)))
    hashed = np.frombuffer(b"".join(hashlib.sha256(s.encode()).digest()[:8] for s in counts), np.uint8).reshape(-1, 8)
    weight = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), MOST_WEIGHT)
    found = np.zeros(64, np.int64)
    for lo in range(0, len(weight), 8192):  # bounds the table of bits
        found += weight[lo : lo + 8192] @ np.unpackbits(hashed[lo : lo + 8192], axis=1).astype(np.int64)
    return int.from_bytes(np.packbits(2 * found > weight.sum()).tobytes(), "big", signed=True)


def simhashes(pages: DataFrame, key: str, text: Column) -> DataFrame:
    """``key``, simhash: signed 64-bit SimHash over four-word shingles, a shingle weighing at most three, hashed by SHA-256.

    A value of one row alone, so rows are worked through where they are: no shuffle, and repeated keys have a row each.
    """
    norm = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}\\s]", " ")

    def work(batches):
        for batch in batches:
            values = [_votes(t.as_py().split()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], [key, "simhash"])

    kind = pages.select(key).dtypes[0][1]
    return pages.select(key, norm.alias("__text")).mapInArrow(work, f"`{key}` {kind}, simhash bigint")


def near_pairs(pages: DataFrame, radius: int = RADIUS, agree: int = AGREE) -> DataFrame:
    """a < b, distance: pairs of distinct fingerprints (column ``simhash``) within ``radius`` bits, as an equi-join.

    Equal fingerprints are one vertex, so a large group of copies costs one row.  The bits fall into ``radius`` + ``agree`` blocks;
    two fingerprints within the radius agree in ``agree`` of them at least, so one table for each choice of that many blocks,
    keyed by their bits, meets every pair.  With three agreeing blocks a key has about half the bits, and chance
    meetings stay few for billions of rows.  A pair is given by the first table in which it meets.  The join is a sort-merge
    join by hint: Spark takes the rows of all tables for as few as the fingerprints and would send them through the driver.
    """
    blocks = radius + agree
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    bits = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(choice) for choice in combinations(bits, agree)]
    masks = [m - 2**64 if m >= 2**63 else m for m in masks]
    tables = F.array(*(F.struct(F.lit(t).alias("table"), F.col("h").bitwiseAND(F.lit(m)).alias("value")) for t, m in enumerate(masks)))
    each = pages.select(F.col("simhash").alias("h")).distinct().select("h", F.explode(tables).alias("at")).select("h", "at.table", "at.value").hint("merge")
    met = each.withColumnRenamed("h", "a").join(each.withColumnRenamed("h", "b"), ["table", "value"]).filter("a < b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*(F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)))
    return met.filter((F.bit_count(x) <= radius) & (F.col("table") == first)).select("a", "b", F.bit_count(x).alias("distance"))


def canonical(pages: DataFrame, group: str) -> DataFrame:
    """For each group the page that stands for it: its own canonical first, then tier, first seen, id."""
    own = F.when(F.col("canonical_url") == F.col("url"), 0).otherwise(1)
    tier = F.when(F.col("tier") == "T1", 0).when(F.col("tier") == "T2", 1).otherwise(2)
    return pages.groupBy(group).agg(F.min(F.struct(own.alias("o"), tier.alias("t"), "first_seen", "page_id"))["page_id"].alias("canonical"))


def repeated_blocks(blocks: DataFrame, least: int = 3) -> DataFrame:
    """host, block, pages: blocks that at least ``least`` pages of a host have.

    Blocks meet by a 128-bit hash, pages are counted after rows that repeat on a page are one, and only a block's first text travels
    along with its partial counts.
    """
    first = blocks.groupBy("host", F.md5("block").alias("key"), "page_id").agg(F.min("block").alias("block"))
    counted = first.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"), F.min("block").alias("block"))
    return counted.filter(F.col("pages") >= least).select("host", "block", "pages")


def without_boilerplate(blocks: DataFrame, repeated: DataFrame, title: str | None = None) -> DataFrame:
    """Blocks that are not repeated on their host; headings of level one, list items and the page's own title always stay."""
    keep = F.col("block").rlike("^(# |[-*+] )")
    if title:
        keep = keep | F.coalesce(F.lower(F.trim("block")) == F.lower(F.trim(title)), F.lit(False))
    known = repeated.select(F.col("host").alias("__host"), F.md5("block").alias("__key")).distinct()
    other = blocks.filter(~keep).withColumn("__key", F.md5("block"))
    left = other.join(known, (other["host"] == known["__host"]) & (other["__key"] == known["__key"]), "left_anti")
    return blocks.filter(keep).unionByName(left.select(*blocks.columns))


def resolved(pages: DataFrame, pairs: DataFrame, order: list[str]) -> DataFrame:
    """page_id, duplicate_of: the page that stands for each page's component of near copies, the first by ``order`` and id.

    ``pages``: page_id, simhash and the columns of ``order``; ``pairs``: linked fingerprints (a, b).  Labels go to the least linked
    fingerprint again and again until none changes; only fingerprints that have a link take part, and each round is
    written.  All joins are sort-merge joins by hint: Spark would send labels and links through the driver, in every round.
    """
    links = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(links.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = links.hint("merge").join(labels.select(F.col("a").alias("b"), "label"), "b").select("a", "label", F.lit(None).cast("bigint").alias("own"))
        least = near.unionByName(labels.select("a", "label", F.col("label").alias("own"))).groupBy("a").agg(F.min("label").alias("label"), F.max("own").alias("own"))
        # The label's own label, so that a chain is halved each round; a label is a linked fingerprint and has one.
        up = labels.select(F.col("a").alias("label"), F.col("label").alias("up"))
        labels = written(least.hint("merge").join(up, "label").select("a", F.col("up").alias("label"), (F.col("up") < F.col("own")).alias("moved")), "labels")
        if not labels.filter("moved").limit(1).count():
            break
    held = pages.hint("merge").join(labels.select(F.col("a").alias("simhash"), "label"), "simhash", "left").withColumn("__group", F.coalesce("label", "simhash"))
    first = held.groupBy("__group").agg(F.min(F.struct(*order, "page_id"))["page_id"].alias("first"))
    return held.hint("merge").join(first, "__group").select("page_id", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("duplicate_of"))


def inlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """page_id, inlinks: distinct pages that link to it, zero included."""
    counted = links.groupBy("to").agg(F.countDistinct("from_page").alias("inlinks"))
    return pages.join(counted, pages["key"] == counted["to"], "left").select("page_id", F.coalesce("inlinks", F.lit(0)).cast("bigint").alias("inlinks"))
