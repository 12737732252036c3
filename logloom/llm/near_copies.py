"""Near copies by five-word shingles: documents whose shingle sets have a Jaccard similarity of 0.8 or more.

Two ways propose pairs, the shingle sets decide.  Each distinct set is one node.  SimHash comes first:
the 64 bits over a set's shingle hashes meet by the ball hashing of ``simhash.links``, so every pair within its
``RADIUS`` bits is reached over its links.  At similarity 0.8 about ten bits of 64 differ, beyond any ball that can
be listed, so MinHash proposes as well: a set gets ``BANDS`` keys of ``ROWS`` minima each, and two sets of similarity s share none of the keys with
probability (1 - s^ROWS)^BANDS: 7 in 100,000 at 0.8, fewer above.  A pair that shares a key is
compared by its exact sets, unless one of them is too small for the other.

No key lists its pairs.  First each member of a key meets the key's smallest member, and components
are formed from the links found; so a family of copies costs its size.  What is left are open keys,
whose members are in several components.  A task takes such a key whole and grows its components:
the sets reached so far are compared with those not reached yet, all at once by the lists of the
shingles they share, and a set that is reached is not compared again.  Rows are one a member.

A key with more than ``GROUP`` members (or ``GROUP_SHINGLES`` shingles) is no single task's work: its members
meet under this key and each further key that they share, and so on until groups are small.  A pair at
similarity 0.8 shares 7.9 keys of 24 on average, at least two with probability 0.9991 and at least three
with 0.994, and members that share all keys, which have the same 120 minima, meet the smallest of them.

Defined cases: a null or empty text, or one of white space, has the empty set, and all such texts are
one node; fewer than five words are one shingle; rows that repeat a ``doc_id`` are one document (one
row each stays in the result); a null ``doc_id`` has no component and links nothing; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import staged
from .simhash import COUNTED, LOWER, WORDS, components

SHINGLE, BANDS, ROWS, SEED = 5, 24, 5, 42
#: The similarity as a fraction, so that the comparison is one of whole numbers.
OVER, UNDER = 4, 5
#: What a task compares at most under one key.
GROUP, GROUP_SHINGLES = 4096, 4_000_000
#: Shingles that meet all permutations at once; words whose hashes a worker keeps.
AT_ONCE, KEPT = 4096, 1 << 18
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_DRAWS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
_FACTOR, _SHIFT = _DRAWS[0] | np.uint64(1), _DRAWS[1]


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= KEPT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode(), SEED)
        return found


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = WORDS.findall((text or "").translate(LOWER))
    hashes = np.fromiter((_HASHES[w] for w in words), np.uint64, len(words))
    width = min(len(words), SHINGLE)
    if not width:
        return hashes
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * _PRIME + hashes[k : k + n]
    return np.unique(_mixed(out))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key per band, none for the empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), AT_ONCE):
        least = np.minimum(least, (np.multiply.outer(_FACTOR, found[at : at + AT_ONCE]) + _SHIFT[:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _PRIME + row)
    return keys.view(np.int64)


def bits(found: np.ndarray) -> int:
    """The SimHash fingerprint of a shingle set as a signed number: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), COUNTED):
        part = found[at : at + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def digest(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - 2**63


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, fp (names the shingle set), n (its size), bits (its SimHash), bands."""

    @F.pandas_udf("fp bigint, n bigint, bits bigint, bands array<bigint>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t) for t in texts]
            yield pd.DataFrame({"fp": [digest(s) for s in sets], "n": [len(s) for s in sets], "bits": [bits(s) for s in sets], "bands": [band_keys(s) for s in sets]})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), sketch(F.col("text")).alias("s")).select("doc_id", "s.*")


def _may_be_similar(n: Column, m: Column) -> Column:
    return F.least(n, m) * UNDER >= F.greatest(n, m) * OVER


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of set names whose sets are similar; texts: (fp, text)."""

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, found = None, None  # the join leaves rows of one a together
        for left, right in batches:
            out = []
            for a, b in zip(left, right, strict=True):
                if a != last:
                    last, found = a, shingles(a)
                out.append(similar(found, shingles(b)))
            yield pd.Series(out, dtype=bool)

    of = lambda side: texts.select(F.col("fp").alias(side), F.col("text").alias(f"{side}_text")).hint("merge")
    return pairs.join(of("b"), "b").join(of("a"), "a").where(near("a_text", "b_text")).select("a", "b")


def grown(sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Links between similar sets that join the labels of all similar ones; sets of one label are joined already."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, kin = np.unique(labels, return_inverse=True)
    by_kin = np.argsort(kin, kind="stable")
    kin_at = np.searchsorted(kin[by_kin], np.arange(kin.max() + 2))
    open_ = np.ones(len(sets), bool)
    found, listed = [], 0

    def lists() -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(open_[owner])
        rows = rows[np.argsort(token[rows], kind="stable")]
        return owner[rows], np.searchsorted(token[rows], np.arange(token.max() + 2))

    for first in range(len(sets)):
        if not open_[first]:
            continue
        front = by_kin[kin_at[kin[first]] : kin_at[kin[first] + 1]].tolist()
        open_[front] = False
        while front and open_.any():
            # The lists shrink with the sets that are still open.
            if not listed or open_.sum() * 2 < listed:
                holders, at = lists()
                listed = int(open_.sum())
            x = front.pop()
            own = token[starts[x] : starts[x + 1]]
            lo, n = at[own], at[own + 1] - at[own]
            place = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(holders[place], minlength=len(sets))
            near = np.flatnonzero(open_ & (both * UNDER >= OVER * (sizes + sizes[x] - both)) & (both > 0))
            for y in near.tolist():
                if open_[y]:
                    found.append((x, y))
                    family = by_kin[kin_at[kin[y]] : kin_at[kin[y] + 1]]
                    open_[family] = False
                    front.extend(family.tolist())
    return found


def _open(rows: DataFrame) -> DataFrame:
    """Sizes of the keys whose members are in several components."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("label").alias("one"), F.max("label").alias("other"))
    fits = (F.col("members") <= GROUP) & (F.col("shingles") <= GROUP_SHINGLES)
    return sizes.where("one <> other").select("key", fits.alias("fits"))


def _grown_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, fp, label) of keys that fit a task -> links (a, b)."""

    def grow(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy()
        sets = [shingles(t) for t in group.column("text").to_pylist()]
        pairs = np.array(grown(sets, group.column("label").to_numpy()), np.int64).reshape(-1, 2)
        return pa.table({"a": fps[pairs].min(axis=1), "b": fps[pairs].max(axis=1)})

    return rows.join(texts.hint("merge"), "fp").select("key", "fp", "label", "text").groupBy("key").applyInArrow(grow, "a bigint, b bigint")


def open_links(rows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, band, fp, n, label) -> links that join the components of similar sets under one key."""
    out = None
    while True:
        sizes = staged(_open(rows), "open-keys")
        small = rows.join(sizes.where("fits").hint("merge"), "key", "left_semi")
        links = staged(_grown_links(small, texts), "grown-links")
        out = links if out is None else out.unionAll(links)
        large = rows.join(sizes.where("not fits").hint("merge"), "key", "left_semi")
        if large.limit(1).count() == 0:
            return out.distinct()
        # Sets that share every key meet the smallest one; the others meet again under one key more.
        last = large.where(F.col("band") == BANDS - 1)
        low = last.groupBy("key").agg(F.min("fp").alias("low"))
        alike = last.join(low.hint("merge"), "key").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
        out = out.unionAll(staged(verified(alike, texts), "alike-links"))
        more = large.join(nodes.select("fp", "bands").hint("merge"), "fp").select("key", "band", "fp", "n", "label", F.posexplode("bands").alias("next", "other"))
        more = more.where("next > band").select(F.xxhash64("key", "other").alias("key"), F.col("next").alias("band"), "fp", "n", "label")
        rows = staged(more, "further-keys")


def ball_pairs(nodes: DataFrame) -> DataFrame:
    """(fp, first, n, bits) distinct -> pairs (a, b) with both sizes and documents: sets of one SimHash meet the smallest of
    them, and those smallest ones meet where their fingerprints are linked."""
    of = nodes.select("bits", F.struct("fp", "n", "first").alias("set"))
    least = staged(of.groupBy("bits").agg(F.min("set").alias("low")), "balls")
    alike = of.join(least.hint("merge"), "bits").select(F.col("low").alias("x"), F.col("set").alias("y"))
    side = lambda name, at: least.select(F.col("bits").alias(at), F.col("low").alias(name)).hint("merge")
    near = simhash.links(least.select(F.col("bits").alias("fp"))).join(side("x", "a"), "a").join(side("y", "b"), "b").select("x", "y")
    met = alike.unionAll(near).where((F.col("x.fp") != F.col("y.fp")) & _may_be_similar(F.col("x.n"), F.col("y.n")))
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return met.select(low["fp"].alias("a"), high["fp"].alias("b"), low["first"].alias("a_doc"), high["first"].alias("b_doc"))


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, first, n, bits, bands) distinct -> links (a, b) whose components are those of all similar pairs that share a key,
    and of the similar ones among those that SimHash links."""
    balls = staged(ball_pairs(nodes), "ball-pairs")
    keyed = nodes.select("fp", "first", "n", F.posexplode("bands").alias("band", "key"))
    least = keyed.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("low"), F.count("*").alias("members")).where("members > 1")
    shared = staged(keyed.join(least.hint("merge"), "key").select("key", "band", "fp", "first", "n", "low"), "shared-keys")
    # A repeated id brings all its texts here; the set's name tells which is meant.
    wanted = shared.select("first").unionAll(balls.select("a_doc")).unionAll(balls.select("b_doc"))
    wanted = wanted.select(F.col("first").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id", "left_semi")

    @F.pandas_udf("bigint")
    def name(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([digest(shingles(t)) for t in part], dtype="int64")

    texts = staged(texts.select(name("text").alias("fp"), "text").dropDuplicates(["fp"]), "texts")
    stars = shared.where((F.col("fp") != F.col("low.fp")) & _may_be_similar(F.col("n"), F.col("low.n")))
    pairs = stars.select(F.col("low.fp").alias("a"), F.col("fp").alias("b")).unionAll(balls.select("a", "b")).distinct()
    found = staged(verified(pairs, texts), "star-links")
    labels = components(found)
    tagged = shared.join(labels.hint("merge"), shared["fp"] == labels["node"], "left")
    tagged = staged(tagged.select("key", "band", "fp", "n", F.coalesce("label", "fp").alias("label")), "tagged")
    return found.unionAll(open_links(tagged, nodes, texts))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over links) of every row."""
    rows = staged(sketches(docs), "sketches")
    known = rows.where("doc_id is not null")
    nodes = staged(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "nodes")
    # A document may hold several texts (repeated ids): they are linked as well.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
    own = rows.join(several.hint("merge"), "doc_id").where("fp <> a").select("a", F.col("fp").alias("b"))
    name = lambda side: nodes.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_doc")).hint("merge")
    edges = links(nodes, docs).unionAll(own).join(name("a"), "a").join(name("b"), "b").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))
    labels = components(edges.where("a <> b"))
    of = nodes.join(labels.hint("merge"), nodes["first"] == labels["node"], "left")
    of = staged(of.select("fp", F.coalesce("label", "first").alias("component_id")), "components")
    out = rows.select("doc_id", "fp").join(of.hint("merge"), "fp", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
