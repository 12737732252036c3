"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source are dealt to blocks by hash: ``BUCKETS`` of them, or more where the
table has over ``BLOCK_ROWS`` rows for each.  A source's target says
how many passes over its blocks the mix makes: whole passes, and of one more pass as many blocks
of a seeded permutation as the words that are left need; the last of these blocks is taken up to
the word.  So each source brings an exact quota of block draws.  A binary tree splits the quota
vector among the output shards: at a node the left half draws its vector from the multivariate
hypergeometric law of the node's vector, the right half keeps the rest, down to single shards.
The shards then take consecutive, disjoint runs of each source's permuted draws and shuffle their
documents by hash.

Blocks, quotas and tree nodes are counts: a source has at most three draws a block, a block few rows
even of a hot source, and texts meet their draws by (source, block), so a hot source is dealt over many
tasks.  Seeds and ids decide everything; a rerun or a lost executor gives the same mix.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; texts
without words are drawn with their block and add nothing; rows that repeat a document are separate
rows of equal rights; an empty table gives an empty mix; other columns are carried in one struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, blank, global_rank, staged

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BUCKETS, BLOCK_ROWS, SHARD_DRAWS, LEVELS, SEED = 1024, 16384, 256, 6, 20240501


def n_words(text: Column) -> Column:
    return F.regexp_count(blank(text), F.lit(WORD)).cast("bigint")


def _key(source: Column) -> Column:
    """Sorts by code point with null last, and is never null."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size) -> the same with ``target``: ``share`` of all sizes by weight, at most ``most`` x source_size.

    What capped sources leave is shared again by weight.  Each round is one aggregation to a few
    numbers; a round caps at least one more source or is the last.
    """
    ranked = global_rank(sizes, "key", "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    ranked = staged(ranked.select("key", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    first = ranked.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    if first["total"] is None:
        return ranked.select("key", "source_size", F.lit(0.0).alias("target"))
    goal, level, capped = share * first["total"], share * first["total"] / first["weight"], -1
    while True:
        full = F.col("cap") <= F.col("weight") * level
        seen = ranked.agg(
            F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("free")
        ).first()
        if seen["n"] == capped or seen["free"] is None:
            break
        capped, level = seen["n"], (goal - seen["used"]) / seen["free"]
    return ranked.select("key", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def _draws(blocks: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(key, bucket, epoch, slot, words): the block draws of each source in permuted order."""
    goal = F.round("target").cast("bigint")
    of = blocks.join(targets.hint("merge"), "key").withColumn("goal", goal)
    passes = F.when(F.col("source_size") > 0, F.expr("cast(goal div source_size as int)")).otherwise(F.lit(0))
    of = of.withColumn("passes", passes).withColumn("rest", F.expr("goal - passes * source_size"))
    of = of.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes")))).where("epoch < passes or rest > 0")
    of = of.withColumn("turn", F.xxhash64(F.lit(seed), "key", "epoch", "bucket"))
    order = Window.partitionBy("key", "epoch").orderBy("turn", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    of = of.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))).where("epoch < passes or before < rest")
    take = F.when(F.col("epoch") < F.col("passes"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("before")))
    slot = F.row_number().over(Window.partitionBy("key").orderBy("epoch", "turn", "bucket")) - 1
    return of.select("key", "bucket", "epoch", slot.alias("slot"), take.alias("words"))


def _split(lo: int, hi: int, keys: list[str], counts: np.ndarray, levels: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    if levels == 0 or hi - lo == 1:
        yield lo, hi, counts
        return
    mid = (lo + hi) // 2
    left_size = int(counts.sum()) * (mid - lo) // (hi - lo)
    left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, left_size, method="marginals")
    yield from _split(lo, mid, keys, left, levels - 1, seed)
    yield from _split(mid, hi, keys, counts - left, levels - 1, seed)


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED, levels: int = LEVELS) -> DataFrame:
    """(key, n) -> (shard, key, n): exact quotas split among ``shards`` shards.

    A step splits every node ``levels`` times, so nodes of one depth run side by side; a node's
    vector has one count per source.
    """
    schema = "lo int, hi int, key string, n bigint"

    def divide(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("key")
        keys, lo, hi = node["key"].tolist(), int(node["lo"].iloc[0]), int(node["hi"].iloc[0])
        parts = [
            pd.DataFrame({"lo": a, "hi": b, "key": keys, "n": counts})
            for a, b, counts in _split(lo, hi, keys, node["n"].to_numpy(np.int64), levels, seed)
        ]
        out = pd.concat(parts)
        return out[out["n"] > 0]

    nodes, wide = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "key", "n"), shards
    while wide > 1:
        nodes = nodes.groupBy("lo", "hi").applyInPandas(divide, schema)
        wide = -(-wide // 2**levels)
    return nodes.select(F.col("lo").alias("shard"), "key", "n")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
    shard_draws: int = SHARD_DRAWS, carry: list[str] | None = None,
) -> DataFrame:
    """``row`` (the columns ``carry`` of docs, all if not given; doc_id among them), size, source_size, target and ``copies``: (shard, epoch, words) of each copy the mix takes."""
    buckets = max(BUCKETS, -(-docs.count() // BLOCK_ROWS))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)).cast("int")
    slim = docs.select(_key(F.col("source")).alias("key"), bucket.alias("bucket"), n_words(F.col("text")).alias("size"))
    blocks = staged(slim.groupBy("key", "bucket").agg(F.sum("size").alias("words")), "blocks")
    targets = staged(source_targets(blocks.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    draws = staged(_draws(blocks, targets, seed), "draws")
    quotas = draws.groupBy("key").agg(F.count("*").alias("n"))
    total = draws.count()
    leaves = splitting_tree(quotas, max(1, -(-total // shard_draws)), seed)
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = leaves.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    slots = runs.select("key", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("slot"))
    dealt = draws.join(slots.hint("merge"), ["key", "slot"]).groupBy("key", "bucket").agg(F.collect_list(F.struct("shard", "epoch", "words")).alias("draws"))
    plan = blocks.select("key", "bucket").join(targets.hint("merge"), "key").join(dealt.hint("merge"), ["key", "bucket"], "left")
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), _key(F.col("source")).alias("key"), bucket.alias("bucket"), n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed + 1), "doc_id").alias("turn"))
    inside = Window.partitionBy("key", "bucket").orderBy("turn", "row.doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = "greatest(0L, least(size, d.words - ahead))"
    copies = F.expr(f"transform(filter(coalesce(draws, array()), d -> {words} > 0 or (size = 0 and ahead <= d.words)), d -> struct(d.shard as shard, d.epoch as epoch, {words} as words))")
    return rows.join(plan.hint("merge"), ["key", "bucket"]).select("row", "size", "source_size", "target", copies.alias("copies"))


def mixture(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: one row per copy with ``row``, shard, epoch, words, size; shards lie together, each in its own shuffled order.

    Only the last block of a source is taken up to a word, so at most one copy per source holds
    ``words`` below ``size``.
    """
    copies = mixed.select("row", "size", F.explode("copies").alias("c")).select("row", "size", "c.shard", "c.epoch", "c.words")
    turn = F.xxhash64(F.lit(seed + 2), "shard", "epoch", "row.doc_id")
    return copies.withColumn("turn", turn).repartition("shard").sortWithinPartitions("shard", "turn").drop("turn")
