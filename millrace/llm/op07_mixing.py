"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a target of words: its share of the total by weight, at most
``MAX_EPOCHS`` times its own size, what is cut off going to the other sources by weight
until none is above.  A target of 2.3 times the size takes every document twice and
draws the rest without replacement.

The draw works on blocks.  A source's documents are dealt into permuted blocks by a hash
of their key, one block a few thousand words; a block-draw is one block taken once.
Blocks are drawn in permuted order until the source's remainder is met; inside the one
block that is cut, documents are drawn in permuted order as far as they fit, then the shortest of the others, the last only if that
brings the sum nearer the target.

Block-draws are then split among output shards by a multivariate-hypergeometric tree:
the shards are halved again and again, and each half receives its exact number of
block-draws, how many of each source being drawn hypergeometrically from the node's
quotas.  A source's draws, in permuted order, fill its quotas shard after shard; inside a
shard documents are shuffled by a hash.

The driver sees one row per source (name, rows, words), never documents or blocks.
All choices come from MD5 of keys and a fixed seed, so reruns agree.

Edge cases: a null text has size 0; documents without words are taken as often as the
whole-number part says, at no words.  Null source is a source, last in order.  Rows that share an id are dealt by a hash of their
text too; equal rows share a block and are taken one by one.  A very long document may be all of a block: it is
taken whole or not at all.  An empty table gives no rows; ``mix`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SHARDS = 16
SEED = 11
#: Words that a permuted block holds on average.
BLOCK_WORDS = 200_000
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MAX_EPOCHS) -> list[float]:
    """Each source's words: shares of the total by weight, at most ``most`` times its size, the excess dealt again by weight."""
    total, capped = float(sum(sizes)), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in sorted(capped))
        share = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / share > most * sizes[i]]
        if not above:
            return [most * sizes[i] if i in capped else left * weights[i] / share for i in range(len(sizes))]
        capped.update(above)


def splitting_tree(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Block-draws by (shard, source): exact totals in both directions, split at random node by node."""
    draw = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        n = int(have.sum())
        left = np.zeros_like(have)
        need, rest = n * (mid - lo) // (hi - lo), n
        for i, k in enumerate(have):
            rest -= int(k)
            left[i] = draw.hypergeometric(int(k), rest, need) if k and need else 0
            need -= int(left[i])
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def _place(*parts: Column | str) -> Column:
    """A number in [0, 2^48) from the MD5 of the parts."""
    columns = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, 12), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, source and ``tag`` (hash of the text: tells rows apart that share an id)."""
    return docs.select(
        F.col("doc_id"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.col("source"),
        F.xxhash64("text").alias("tag"),
    )


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MAX_EPOCHS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: source_size, target, epochs (whole passes), remainder (words to draw), blocks."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["size"]) for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most) if sizes else []
    made = []
    for r, size, aim in zip(found, sizes, aims):
        epochs = min(floor(aim / size), int(most)) if size else 0
        made.append((r["source"], size, float(aim), epochs, max(0.0, float(aim - epochs * size)), max(1, min(int(r["rows"]), -(-size // block_words)))))
    return rows.sparkSession.createDataFrame(made, "source string, source_size bigint, target double, epochs int, remainder double, blocks int")


def mixed(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MAX_EPOCHS, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``rows`` (doc_id, size, source, tag) plus source_size, target, ``copies`` and ``draws`` (output shards of the copies)."""
    spark = rows.sparkSession
    rows = common.written(rows, "mix-rows")
    sources = plan(rows, weights, most, block_words)
    seed = str(SEED)
    blocked = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["source"])).select(
        rows["*"],
        "source_size",
        "target",
        "epochs",
        "remainder",
        (_place("block", F.lit(seed), rows["doc_id"], rows["tag"]) % F.col("blocks")).alias("__block"),
    )
    # Blocks in permuted order (their numbers come from a hash): words before each block.
    earlier = Window.partitionBy("source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocked.groupBy("source", "__block")
        .agg(F.sum("size").alias("__words"), F.first("remainder").alias("__rem"), F.first("epochs").alias("__epochs"))
        .withColumn("__before", F.coalesce(F.sum("__words").over(earlier), F.lit(0)))
        .withColumn("__left", F.col("__rem") - F.col("__before"))
        .withColumn("__cut", (F.col("__left") > 0) & (F.col("__left") < F.col("__words")))
        .withColumn("__whole", (F.col("__words") > 0) & (F.col("__left") >= F.col("__words")))
    )
    blocks = common.written(blocks, "mix-blocks")
    # One draw a pass, and one more for what the remainder takes whole or in part.
    drawn = blocks.select("source", "__block", F.explode(F.sequence(F.lit(0), F.col("__epochs"))).alias("__pass"), "__epochs", "__whole", "__cut").filter(
        (F.col("__pass") < F.col("__epochs")) | F.col("__whole") | F.col("__cut")
    )
    quotas = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(quotas, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    tree = splitting_tree([quotas[s] for s in names], shards) if names else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(tree, axis=0)
    leaves = [(s, k, int(ends[k][i] - tree[k][i]), int(ends[k][i])) for i, s in enumerate(names) for k in range(shards) if tree[k][i]]
    leaf = spark.createDataFrame(leaves, "leaf_source string, __shard int, __from bigint, __to bigint")
    order = Window.partitionBy("source").orderBy(_place("draw", F.lit(seed), F.col("source"), F.col("__block"), F.col("__pass")), "__block", "__pass")
    drawn = drawn.withColumn("__rank", F.row_number().over(order) - 1)
    drawn = drawn.join(
        F.broadcast(leaf),
        drawn["source"].eqNullSafe(leaf["leaf_source"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")),
    )
    per_block = drawn.groupBy("source", "__block").agg(
        F.sort_array(F.collect_list(F.struct("__pass", "__shard"))).alias("__draws"),
    )
    facts = blocks.alias("b").join(
        per_block.alias("p"),
        F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.__block") == F.col("p.__block")),
        "left",
    )
    facts = facts.select(F.col("b.source").alias("__source"), F.col("b.__block").alias("__b"), "__left", "__cut", "__whole", "__draws")
    rows = blocked.join(facts, blocked["source"].eqNullSafe(facts["__source"]) & (F.col("__block") == F.col("__b"))).drop("__source", "__b")
    # Only a cut block is ordered document by document: one block per source, of bounded size.
    whole = rows.filter(~F.col("__cut")).withColumn("copies", F.col("epochs") + F.col("__whole").cast("int"))
    # Documents in permuted order as far as they fit; of the others the shortest fill what is left, so one that is refused is in no other's way.
    keys = [_place("doc", F.lit(seed), F.col("doc_id"), F.col("tag")), "doc_id", "tag", "size"]
    upto = (Window.unboundedPreceding, Window.currentRow)
    permuted = Window.partitionBy("source", "__block").orderBy(*keys).rowsBetween(*upto)
    shortest = Window.partitionBy("source", "__block", "__fits").orderBy("size", *keys).rowsBetween(*upto)
    cut = (
        rows.filter(F.col("__cut"))
        .withColumn("__sum", F.sum("size").over(permuted))
        .withColumn("__fits", F.col("__sum") <= F.col("__left"))
        .withColumn("__taken", F.coalesce(F.max(F.when(F.col("__fits"), F.col("__sum"))).over(Window.partitionBy("source", "__block")), F.lit(0)))
        .withColumn("__more", F.col("__taken") + F.sum("size").over(shortest) - F.col("size") / 2.0 <= F.col("__left"))
        .withColumn("copies", F.col("epochs") + (F.col("__fits") | F.col("__more")).cast("int"))
        .drop("__sum", "__fits", "__taken", "__more")
    )
    return (
        whole.unionByName(cut)
        .withColumn("draws", F.slice(F.transform(F.coalesce("__draws", F.array()), lambda d: d["__shard"]), 1, F.greatest("copies", F.lit(0))))
        .drop("__left", "__cut", "__whole", "__draws", "__block", "epochs", "remainder")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken; then copies and the output shards of the copies."""
    out = mixed(sized(common.documents(spark, sf_dir)))
    return out.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("draws")).cast("bigint").alias("taken"),  # what the tree's leaves hold of it
        F.col("copies").cast("int").alias("copies"),
        "draws",
    )


def mix(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, repeated as often as it takes them, in shuffled order within output shards.

    What each row draws is found without the texts and joined to them by id, hash of the text, source and a number among
    rows that share all three; only such rows, few as a rule, are numbered.
    """
    columns, key = docs.columns, ["doc_id", "tag", "source"]
    numbered = Window.partitionBy(*key).orderBy("draws")
    drawn = mixed(sized(docs)).select(*key, "draws").withColumn("__n", F.row_number().over(numbered))
    drawn = common.written(drawn.select(*(F.col(c).alias(f"__{c}") for c in (*key, "draws")), "__n"), "mix-draws")
    rows = docs.withColumn("__own", F.xxhash64("text"))
    same = lambda left, right: (left["doc_id"].eqNullSafe(right["__doc_id"])) & (left["__own"] == right["__tag"]) & left["source"].eqNullSafe(right["__source"])
    several = drawn.filter("__n = 2").select("__doc_id", "__tag", "__source")
    order = Window.partitionBy("doc_id", "__own", "source").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in columns)))
    single = rows.join(several, same(rows, several), "left_anti").withColumn("__k", F.lit(1))
    repeated = rows.join(several, same(rows, several), "left_semi").withColumn("__k", F.row_number().over(order))
    every = single.unionByName(repeated)
    taken = every.join(drawn, same(every, drawn) & (every["__k"] == drawn["__n"])).select(*(every[c] for c in columns), "__own", F.posexplode("__draws").alias("__pass", "__shard"))
    shuffled = taken.withColumn("__at", _place("local", F.lit(str(SEED)), F.col("doc_id"), F.col("__own"), F.col("__pass")))
    return shuffled.repartitionByRange("__shard", "__at").sortWithinPartitions("__shard", "__at").select(*columns)


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
