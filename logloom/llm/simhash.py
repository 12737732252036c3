"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within ``RADIUS`` bits share a midpoint within half the radius of both.  So each
fingerprint emits the variants in such a ball, fingerprints meet on equal variants, and the pairs
that collide are deduplicated and verified.  The ball over all 64 bits has 2,081 variants.  It is
not needed for most: of two 32-bit halves one differs in at most half the bits, so a ball of radius
1 over each half (2 x 33 variants) already meets every pair.  Pairs are verified inside a variant's
group.  A group of up to ``PAIRS`` fingerprints gives its links as they are, one of up to ``GROUP``
a spanning forest of them.  A larger one (a huge family of copies) is not held in one task: its
members emit the full ball of radius 2 over 64 bits, where sharing a variant proves a link, and
each variant links its members to its smallest one only.  All three ways are exact: no component
loses a link between different fingerprints, and no large group lists its pairs.

Copies meet first: one fingerprint is one node, named by its smallest document.  Components come
from alternating large-star and small-star steps over the links, staged in the shared folder.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and is linked like
any other; fewer than four words are one shingle; rows that repeat a ``doc_id`` are one document (one
row each stays in the result); a null ``doc_id`` has a fingerprint and no component and links nothing;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SHINGLE, SEED, RADIUS, PAIRS, GROUP = 4, 42, 4, 24, 4096
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16
ROUNDS = 60


def fingerprint(text: str | None) -> int:
    import xxhash

    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, COUNTED):
        part = range(at, min(n, at + COUNTED))
        hashes = np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE]).encode(), SEED) for i in part), "<u8", len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a bigint)."""

    @F.pandas_udf("bigint")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), bits(F.col("text")).alias("fp"))


#: Masks of one half: nothing and each single bit; and of all 64 bits: nothing, one bit, two bits.
HALF_BALL = "concat(array(0L), transform(sequence(0, 31), a -> shiftleft(1L, a)))"
FULL_BALL = (
    "concat(array(0L), flatten(transform(sequence(0, 63), a -> "
    "transform(sequence(0, a), b -> shiftleft(1L, a) | shiftleft(1L, b)))))"
)


def _links_of_groups(radius: int, group: int):
    """Sorted (variant, fp) rows -> verified links (a, b); (fp, null) for members of large groups."""

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = fps = np.empty(0, np.int64)
        large = None  # the variant of an open large group
        for batch in batches:
            keys, fps = np.append(keys, batch["variant"].to_numpy(np.int64)), np.append(fps, batch["fp"].to_numpy(np.int64))
            if large is not None:
                own = int(np.searchsorted(keys != large, True)) if len(keys) else 0
                yield pd.DataFrame({"a": fps[:own], "b": pd.array([None] * own, "Int64")})
                keys, fps = keys[own:], fps[own:]
                if not len(keys):
                    continue
                large = None
            # The last group may go on in the next batch.
            open_at = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if len(keys) - open_at > group:
                large = int(keys[-1])
                yield _verified(keys, fps, radius, group)
                keys, fps = keys[:0], fps[:0]
            else:
                yield _verified(keys[:open_at], fps[:open_at], radius, group)
                keys, fps = keys[open_at:], fps[open_at:]
        yield _verified(keys, fps, radius, group)

    return linked


def _forest(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest: each fingerprint is reached once, by comparing with those not yet reached."""
    rest = fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= radius
            if near.any():
                reached, rest = rest[near], rest[~near]
                front.extend(reached)
                yield np.minimum(reached, x), np.maximum(reached, x)


def _verified(keys: np.ndarray, fps: np.ndarray, radius: int, group: int) -> pd.DataFrame:
    if len(keys) < 2:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": pd.array([], "Int64")})
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    listed = np.repeat(sizes <= min(PAIRS, group), sizes)
    a, b = [], []
    small_keys, small = keys[listed], fps[listed]
    for step in range(1, PAIRS):
        same = np.flatnonzero(small_keys[step:] == small_keys[:-step])
        if not len(same):
            break
        x, y = small[same], small[same + step]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
        a.append(np.minimum(x[near], y[near]))
        b.append(np.maximum(x[near], y[near]))
    for at in np.flatnonzero((sizes > PAIRS) & (sizes <= group)):
        for x, y in _forest(fps[starts[at] : starts[at] + sizes[at]], radius):
            a.append(x)
            b.append(y)
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    pairs = pd.DataFrame({"a": a, "b": pd.array(b, "Int64")}).drop_duplicates()
    big = np.unique(fps[np.repeat(sizes > group, sizes)])
    return pd.concat([pairs, pd.DataFrame({"a": big, "b": pd.array([None] * len(big), "Int64")})])


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """(fp) distinct -> links (a, b) whose components are those of all pairs within ``RADIUS`` bits."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    # The low half's variants stay below 2^32; the high half's get a bit of their own above.
    masks = F.expr(HALF_BALL)
    emitted = F.concat(F.transform(masks, lambda m: low.bitwiseXOR(m)), F.transform(masks, lambda m: high.bitwiseXOR(m).bitwiseOR(F.lit(1 << 32))))
    variants = nodes.select("fp", F.explode(emitted).alias("variant"))
    met = variants.repartition("variant").sortWithinPartitions("variant").mapInPandas(_links_of_groups(RADIUS, group), "a bigint, b bigint")
    met = staged(met, "met")
    pairs = met.where("b is not null")
    members = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    balls = members.select("fp", F.explode(F.expr(FULL_BALL)).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    first = balls.groupBy("variant").agg(F.min("fp").alias("a"))
    stars = balls.join(first.hint("merge"), "variant").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionAll(stars).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """No node has two links up, or links both up and down."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("up")).unionAll(edges.select(F.col("b").alias("node"), F.lit(1).alias("up")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
    return odd.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the smallest node of each node's component, for nodes with links.

    Large-star and small-star steps until every component is a star around its smallest node.  The
    smallest neighbours are staged, so both sides of a join are plain shuffles and a node with very
    many links can be split among tasks; nothing lists the links of a node.
    """
    now = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    for _ in range(ROUNDS):
        if _is_star_forest(now):
            return now.select(F.col("b").alias("node"), F.col("a").alias("label"))
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "least")
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("low").alias("a"), "b").distinct()
        large = staged(large, "large-star")
        # Small star: b's smaller neighbours, and b itself, hang on the smallest of them.
        least = staged(large.groupBy("b").agg(F.min("a").alias("low")), "least")
        small = large.join(least.hint("merge"), "b").where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
        now = staged(small.unionAll(least.select(F.col("low").alias("a"), "b")).distinct(), "small-star")
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def near_duplicates(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of every row."""
    rows = staged(fingerprints(docs), "fingerprints")
    nodes = staged(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = links(nodes.select("fp"), group)
    # A document may hold several texts (repeated ids): they are linked as well.
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
    own = rows.join(several.hint("merge"), "doc_id").where("fp <> a").select("a", F.col("fp").alias("b"))
    name = lambda side: nodes.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_doc")).hint("merge")
    edges = found.unionAll(own).join(name("a"), "a").join(name("b"), "b").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))
    labels = components(edges.where("a <> b"))
    of = nodes.join(labels.hint("merge"), nodes["first"] == labels["node"], "left")
    of = staged(of.select("fp", F.coalesce("label", "first").alias("component_id")), "components")
    out = rows.join(of.hint("merge"), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
