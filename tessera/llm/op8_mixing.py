"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is dealt by hash into blocks of documents, more for a larger source,
and its blocks are put in a permuted order.  A source's target is a whole number of
passes over its blocks and a rest, which takes blocks in that order and, in the
block where it ends, documents in permuted order, the last of them in part.  The
number of block slots so taken is the source's exact quota.

A binary tree deals the quotas to output shards.  A node holds one count for each
source; the left child gets half of the node's slots, and how many of each source is
a draw from the multivariate hypergeometric distribution, made source by source by
inversion.  A leaf's counts are what its shard takes: the shards' runs of slots of a
source are disjoint and follow each other in the permuted order.  Within a shard,
documents are ordered by a hash (the local shuffle).

All of it is DataFrame operations.  Windows order one row for each source, one for
each run of a source's blocks, the blocks of a run, and the documents of the one
block of a source where its rest ends; none of these grows with the rows of a source.

Defined results: a null text has size 0; the null source is a source, the last;
an empty source has target 0; documents of size 0 are never taken; rows that are
repeated are documents of their own, and of rows alike in everything any may be the
one taken in part; a very long document is one document of its block; other columns
are left alone, whatever their names; an empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, discard, documents, let, written

#: Words of a block, on average, and the least blocks of a source as a power of two.
BLOCK_WORDS, LEAST_BITS = 1 << 16, 6
#: Blocks of a run, as a power of two.
RUN_BITS = 12
#: Words of an output shard, on average, and the least levels of the tree.
SHARD_WORDS, LEAST_LEVELS = 1 << 23, 3
#: Standard deviations around the mode beyond which a draw has no weight in double precision.
REACH = 12.0
#: Levels of the tree after which its nodes are dealt anew.
DEAL_LEVELS = 6


def source_key():
    """Orders sources by code point, null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def targets(sources: DataFrame, weights=(3, 1, 2), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to a table with one row for each source (skey, source_size).

    Sources share ``ratio`` times all words by weight and stop at ``cap`` times
    their own size; the excess is shared again.  That is the water level L with
    sum(min(cap * size, weight * L)) = ratio * total: sources ordered by
    cap * size / weight are full up to the one where the level lies lower.
    """
    one = W.partitionBy(F.lit(0))
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(one.orderBy("skey")) - 1) % len(weights) + 1))
    full = F.col("source_size") * F.lit(cap)
    ordered = ranked.withColumn("full", full).withColumn("fills_at", F.col("full") / F.col("weight"))
    by_level = one.orderBy("fills_at", "skey")
    filled = ordered.withColumns({
        "goal": F.sum("source_size").over(one) * F.lit(ratio),
        "full_before": F.coalesce(F.sum("full").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_left": F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)),
    })
    level = (F.col("goal") - F.col("full_before")) / F.col("weight_left")
    # The level is that of the first source which it doesn't fill; supposing later ones full too gives less.
    found = filled.withColumn("level", F.max(F.when(level < F.col("fills_at"), level)).over(one))
    return found.select("skey", "source_size", F.least("full", F.coalesce(F.col("weight") * F.col("level"), F.col("full"))).alias("target"))


def permuted(block: Column, bits: Column, salt: Column) -> Column:
    """The place of a block in a source's order: a bijection of the numbers below 2**bits."""
    mask, half = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, F.greatest(F.lit(1), F.shiftright(bits, 1))
    at = block
    for i in range(3):
        key = F.shiftrightunsigned(F.xxhash64(salt, F.lit(i)), 20)
        at = let((at * F.lit(0x9E3779) + key).bitwiseAND(mask), lambda x: x.bitwiseXOR(F.call_function("shiftright", x, half)))
    return at


def hypergeometric(ours: Column, total: Column, taken: Column, u: Column) -> Column:
    """How many of ``ours`` among ``total`` are in a random ``taken`` of them: the value at ``u``, uniform in [0, 1).

    Values are tried from the mode upwards, then downwards; each one's weight
    follows from the last by the ratio of neighbouring probabilities.
    """
    def walk(mode: Column, low: Column, high: Column) -> Column:
        k, n, t = ours.cast("double"), taken.cast("double"), total.cast("double")
        up = lambda x: (k - x) * (n - x) / ((x + 1) * (t - k - n + x + 1))
        down = lambda x: x * (t - k - n + x) / ((k - x + 1) * (n - x + 1))
        rising, falling = F.sequence(mode, high), F.sequence(mode, low)
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        above = F.aggregate(rising, start, lambda a, x: F.struct((a["w"] * up(x)).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"])
        below = F.aggregate(falling, start, lambda a, x: F.struct((a["w"] * down(x)).alias("w"), (a["sum"] + a["w"] * down(x)).alias("sum")), lambda a: a["sum"])
        begin = F.struct(F.lit(1.0).alias("w"), (u * (above + below)).alias("left"), F.lit(None).cast("long").alias("at"))

        def upwards(a: Column, x: Column) -> Column:
            left = a["left"] - a["w"]
            return F.struct((a["w"] * up(x)).alias("w"), left.alias("left"), F.coalesce(a["at"], F.when(left < 0, x)).alias("at"))

        def downwards(a: Column, x: Column) -> Column:
            w = a["w"] * down(x)
            left = a["left"] - w
            return F.struct(w.alias("w"), left.alias("left"), F.coalesce(a["at"], F.when((left < 0) & (w > 0), x - 1)).alias("at"))

        again = lambda a: F.struct(F.lit(1.0).alias("w"), a["left"].alias("left"), a["at"].alias("at"))
        return F.aggregate(falling, F.aggregate(rising, begin, upwards, again), downwards, lambda a: F.coalesce(a["at"], mode))

    low, high = F.greatest(F.lit(0).cast("long"), taken - (total - ours)), F.least(taken, ours)
    share = ours / F.greatest(total, F.lit(1))
    spread = F.ceil(REACH * F.sqrt(taken * share * (1 - share) * (total - taken) / F.greatest(total - 1, F.lit(1)))) + 8
    mode = F.least(high, F.greatest(low, F.floor((taken + 1) * (ours + 1).cast("double") / (total + 2))))
    return let(F.struct(mode.alias("m"), F.greatest(low, mode - spread).alias("a"), F.least(high, mode + spread).alias("b")), lambda s: walk(s["m"], s["a"], s["b"]))


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """Deals (skey, slots) to 2**levels shards; returns (skey, shard, lo, hi): the shard's run of the source's slots."""
    root = F.array_sort(F.collect_list(F.struct("skey", "slots")))
    nodes = quotas.agg(root.alias("root")).select(F.lit(0).cast("long").alias("shard"), F.col("root.skey").alias("skeys"), F.col("root.slots").alias("counts"))
    for level in range(levels):
        u = lambda i: F.xxhash64(F.lit(seed + level), F.col("shard"), i).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))  # noqa: B023, E731

        def draw(held: Column, item: Column) -> Column:
            own = let(hypergeometric(item["n"], held["total"], held["half"], u(item["i"])), lambda x: F.struct(x.alias("x")))  # noqa: B023
            return let(own, lambda d: F.struct(F.concat(held["left"], F.array(d["x"])).alias("left"), (held["total"] - item["n"]).alias("total"), (held["half"] - d["x"]).alias("half")))

        items = F.transform("counts", lambda n, i: F.struct(n.alias("n"), i.alias("i")))
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
        start = F.struct(F.array().cast("array<bigint>").alias("left"), total.alias("total"), F.shiftright(total, 1).alias("half"))
        left = F.aggregate(items, start, draw, lambda a: a["left"])
        both = F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("counts")), F.struct(F.lit(1).alias("side"), F.zip_with("counts", "left", lambda n, x: n - x).alias("counts")))
        nodes = nodes.withColumn("left", left).select("shard", "skeys", F.explode(both).alias("child"))
        nodes = nodes.select((F.col("shard") * 2 + F.col("child.side")).alias("shard"), "skeys", F.col("child.counts").alias("counts"))
        if level % DEAL_LEVELS == DEAL_LEVELS - 1 and level < levels - 1:
            nodes = nodes.repartition("shard")
    leaves = nodes.select("shard", F.explode(F.arrays_zip(F.col("skeys").alias("skey"), F.col("counts").alias("n"))).alias("leaf")).select("leaf.skey", "shard", "leaf.n").where("n > 0")
    hi = F.sum("n").over(W.partitionBy("skey").orderBy("shard"))
    return leaves.select("skey", "shard", (hi - F.col("n")).alias("lo"), hi.alias("hi"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, as it is."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, *, weights=(3, 1, 2), ratio: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """Draws the mix.  Takes doc_id, text and source; other columns are left alone, and returned if named in ``carry``.

    Returns a row for each document: doc_id, source, size, source_size, target,
    taken and draws, an array of (pass, shard, place, words): the passes that
    take it, the shard each goes to, its place in the order of the shard's local
    shuffle, and the words taken, counted from the document's start (fewer than
    its size for one document of a source at most).  ``taken`` is their sum.
    """
    held = [f"carry_{i}" for i in range(len(carry))]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    read = docs.select("doc_id", "source", size, source_key().alias("skey"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("draw"), *[F.col(c).alias(h) for c, h in zip(carry, held)])
    sized, sized_at = written(read.drop(*held), "mix-sizes")
    sizes = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    quota = targets(sizes, weights, ratio, cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(int(cap)), F.floor(F.round("target") / F.col("source_size")))).otherwise(0).cast("int")
    bits = F.greatest(F.lit(LEAST_BITS), F.ceil(F.log2(F.greatest(F.lit(1), F.col("source_size")) / block_words))).cast("int")
    quota = quota.withColumns({"whole": whole, "bits": bits}).withColumn("rest", (F.round("target") - F.col("whole") * F.col("source_size")).cast("long"))
    quota, quota_at = written(quota, "mix-sources")
    total = quota.agg(F.sum("target").alias("n")).first()["n"] or 0.0
    levels = max(LEAST_LEVELS, math.ceil(math.log2(max(1.0, total / shard_words))))
    blocks = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))
    place = permuted(F.col("draw").bitwiseAND(blocks - 1), F.col("bits"), F.xxhash64(F.lit(seed + 1), "skey"))
    placed = lambda df: df.join(quota.select("skey", "bits"), "skey").withColumn("pos", place).drop("bits")
    by_block, blocks_at = written(placed(sized).groupBy("skey", "pos").agg(F.sum("size").alias("words")), "mix-blocks")
    # How many words come before a block in its source's order: those of the runs before, then those of its own run.
    run = F.shiftright("pos", RUN_BITS).alias("run")
    until = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    runs = by_block.groupBy("skey", run).agg(F.sum("words").alias("n"))
    runs = runs.select("skey", "run", F.coalesce(F.sum("n").over(until(W.partitionBy("skey").orderBy("run"))), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("words").over(until(W.partitionBy("skey", "run").orderBy("pos"))), F.lit(0))
    plan = by_block.select("*", run).withColumn("inside", inside).join(runs, ["skey", "run"]).join(quota, "skey")
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("earlier") - F.col("inside")))
    plan, plan_at = written(plan.withColumn("part", part).select("skey", "pos", "source_size", "target", "whole", "bits", "part", ((part > 0) & (part < F.col("words"))).alias("edge")), "mix-plan")
    used = plan.groupBy("skey").agg((F.first("whole") * F.first(blocks) + F.coalesce(F.max(F.when(F.col("part") > 0, F.col("pos") + 1)), F.lit(0))).cast("long").alias("slots"))
    leaves, leaves_at = written(split_tree(used, levels, seed + 2), "mix-tree")
    # Each slot's shard is the one whose run of slots holds it; both are cut into runs of equal length to meet.
    slots = plan.select("skey", "pos", "whole", "part", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("pass")).where("pass < whole OR part > 0")
    slots = slots.select("skey", "pos", "pass", (F.col("pass") * F.col("blocks") + F.col("pos")).alias("slot")).withColumn("run", F.shiftright("slot", RUN_BITS))
    spans = leaves.withColumn("run", F.explode(F.sequence(F.shiftright("lo", RUN_BITS), F.shiftright(F.col("hi") - 1, RUN_BITS))))
    dealt = slots.join(spans, ["skey", "run"]).where("slot >= lo AND slot < hi")
    dealt = dealt.groupBy("skey", "pos").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pass", "shard")))).alias("shards"))
    plan, dealt_at = written(plan.join(dealt, ["skey", "pos"], "left"), "mix-dealt")
    discard(docs.sparkSession, blocks_at, plan_at, leaves_at)
    rows = placed(read if carry else sized)
    # The one block of each source in which the quota ends is taken document by document.
    edge = rows.join(plan.where("edge"), ["skey", "pos"])
    before = F.sum("size").over(until(W.partitionBy("skey", "pos").orderBy(F.xxhash64(F.lit(seed + 3), "draw"), "draw", "size")))
    at_edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.coalesce(before, F.lit(0)))))
    rest = rows.join(plan.where("NOT edge"), ["skey", "pos"]).withColumn("extra", F.when(F.col("part") > 0, F.col("size")).otherwise(0))
    both = rest.unionByName(at_edge)
    words = lambda i: F.when(i < F.col("whole"), F.col("size")).otherwise(F.col("extra"))
    draw = lambda i: F.struct(i.alias("pass"), F.element_at("shards", i).alias("shard"), F.xxhash64(F.lit(seed + 4), i, F.col("draw")).alias("place"), words(i).cast("long").alias("words"))
    draws = F.filter(F.transform(F.sequence(F.lit(0), F.col("whole")), draw), lambda d: (d["words"] > 0) & d["shard"].isNotNull())
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return both.withColumn("draws", draws).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *[F.col(h).alias(c) for c, h in zip(carry, held)])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, with the shard and the place of each draw."""
    found = mix(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", F.col("draws.shard").alias("shards"), F.col("draws.place").alias("places"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL: dict[str, str] = {}
