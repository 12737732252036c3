"""Phrase collocation mining by SON partitioning.

Documents are dealt to ``SHARDS`` shards (each partition of the input belongs to one).  A phrase
that occurs ``MIN_COUNT`` times must occur ``MIN_COUNT / SHARDS`` times in at least one of them, so
the first pass mines every shard completely at that lower support, and the union of what the shards
find holds every frequent phrase.  A shard is itself cut into blocks and buckets: blocks count their own
phrases, and a bucket adds up the counts of its share of the phrases (``blocks.frequent_keys``).
The union is a bit set of fixed size; where it lets a rare phrase through, the second pass drops it
again, as it counts the candidates over all documents, by their words.  Shares are even by
construction: the support asks for no shard sizes, and uneven shards cost candidates, not results.

The second pass also uses that a phrase of three words is a candidate only if both its pairs are.

Scores are whole numbers: products run in DECIMAL(38, 0), exact up to counts of 10^16 and more.

Defined cases: a null text is empty; a null ``lang`` is ``und``; a null ``doc_id`` or repeated rows
count like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .blocks import PRIME, KeyFilter, bucket_count, byte_set, find_words, mixed, packed, text_blocks, unpacked
from .common import staged

MIN_COUNT, SHARDS, PER_LANG, UNIT, COVER = 10, 4, 2000, 1_000_000, (1, 2)
CUTS = byte_set(b".,;:!?\n\x0b\x0c\r")
WITHIN = ~(CUTS | byte_set(b" \t"))
#: Parts that a language's candidates are ranked in before they meet.
SALTS = 64


class _Phrases:
    """The words of a block, and the places where phrases of two and three words start."""

    def __init__(self, batch: pa.RecordBatch):
        langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        self.langs = langs.dictionary
        words = self.words = find_words(batch.column("text"), WITHIN, lower=True)
        self.codes = words.codes
        doc = words.text_of()
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        # A piece ends at a cut and at the end of a text.
        breaks = np.flatnonzero(CUTS[words.data])
        piece = np.searchsorted(breaks, words.starts)
        joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        self.pairs = np.flatnonzero(joined)
        self.triples = np.flatnonzero(joined[:-1] & joined[1:])

        import xxhash

        self.seeds = np.array([xxhash.xxh64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A hash of language and words for every word, pair and triple."""
        if not len(self.codes):
            return (np.empty(0, np.uint64),) * 3
        values = self.words.hashes()[self.codes]
        one = self.seeds[self.lang] * PRIME + values
        two = one[self.pairs] * PRIME + values[self.pairs + 1]
        three = (one[self.triples] * PRIME + values[self.triples + 1]) * PRIME + values[self.triples + 2]
        return mixed(one + np.uint64(1)), mixed(two + np.uint64(2)), mixed(three + np.uint64(3))


def _shard_blobs(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks([whole]):
                found, n = np.unique(np.concatenate(_Phrases(batch).keys()), return_counts=True)
                rows = list(blocks.key_blobs(found, n, buckets))
                shard = batch.column("shard")[0].as_py() if len(batch) else 0
                yield pa.record_batch([pa.array([b for b, _ in rows], pa.int64()), pa.array([shard] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "shard", "blob"])

    return count


COUNTED = "lang string, size int, phrase string, n bigint"


def _tallied(lang: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each distinct (lang, words)."""
    key = lang
    for column in columns:
        # Dense numbers of the tuples so far: exact, and the next product stays small.
        key = np.unique(key * (column.max() + 1) + column, return_inverse=True)[1] if len(column) else key
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return first, n


def _count_candidates(may_be_frequent: KeyFilter, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            block = _Phrases(batch)
            one, two, three = block.keys()
            hits = may_be_frequent.may_hold(two)
            pair_at = np.zeros(len(block.codes) + 1, bool)
            pair_at[block.pairs[hits]] = True
            # All words of a candidate are frequent, and so are its pairs.
            near = np.flatnonzero(pair_at[block.triples] & pair_at[block.triples + 1])
            near = near[may_be_frequent.may_hold(three[near])]
            words = np.flatnonzero(may_be_frequent.may_hold(one))
            names, parts = block.words.names, []
            for size, at, key in ((1, words, one[words]), (2, block.pairs[hits], two[hits]), (3, block.triples[near], three[near])):
                first, n = _tallied(block.lang[at], [block.codes[at + k] for k in range(size)])
                at = at[first]
                texts = [names.take(pa.array(block.codes[at + k])) for k in range(size)]
                phrase = texts[0] if size == 1 else pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string()))
                parts.append((block.lang[at], np.full(len(at), size), phrase, n, key[first]))
            # How many words each language has.
            n = np.bincount(block.lang, minlength=len(block.langs))
            parts.append((np.arange(len(n)), np.zeros(len(n), np.int64), pa.array([""] * len(n), pa.large_string()), n, block.seeds))
            lang, size, n, key = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3, 4))
            where = blocks.split_key(key, buckets)[0]
            order = np.argsort(where, kind="stable")
            lang, size, n, where = lang[order].astype(np.uint32), size[order].astype(np.uint8), n[order].astype(np.uint32), where[order]
            ends, text = blocks.utf8(pa.concat_arrays([p[2] for p in parts]).take(pa.array(order)))
            rows = []
            for lo, hi in blocks.stretches(where):
                rows.append((int(where[lo]), packed(lang[lo:hi], size[lo:hi], n[lo:hi], np.diff(ends[lo : hi + 1]).astype(np.uint32), text[ends[lo] : ends[hi]])))
            langs = block.langs.to_pylist()
            yield pa.record_batch(
                [pa.array([b for b, _ in rows], pa.int64()), pa.array([langs] * len(rows), pa.list_(pa.string())), pa.array([x for _, x in rows], pa.binary())],
                ["bucket", "langs", "blob"],
            )

    return count


def _sum_bucket(min_count: int):
    def total(rows: pa.Table) -> pa.Table:
        tables = []
        for langs, blob in zip(rows.column("langs").to_pylist(), rows.column("blob").to_pylist(), strict=True):
            lang, size, n, lengths, text = unpacked(blob, np.uint32, np.uint8, np.uint32, np.uint32, np.uint8)
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            phrase = pa.LargeStringArray.from_buffers(len(lang), pa.py_buffer(ends), pa.py_buffer(text))
            named = pa.array(langs, pa.string()).take(pa.array(lang))
            tables.append(pa.table({"lang": named, "size": pa.array(size, pa.int32()), "phrase": phrase, "n": pa.array(n, pa.int64())}))
        out = pa.concat_tables(tables).group_by(["lang", "size", "phrase"]).aggregate([("n", "sum")])
        out = out.filter(pc.or_(pc.greater_equal(out["n_sum"], min_count), pc.equal(out["size"], 0)))
        return pa.table({"lang": out["lang"], "size": out["size"], "phrase": out["phrase"].cast(pa.string()), "n": out["n_sum"]})

    return total


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, shards: int = SHARDS) -> DataFrame:
    """lang, size, phrase, n of all phrases of 1 to 3 words that occur ``min_count`` times; size 0: all words of the language."""
    buckets = bucket_count(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sharded = rows.withColumn("shard", (F.spark_partition_id() % shards).cast("int"))
    found = sharded.mapInArrow(_shard_blobs(buckets), "bucket bigint, shard int, blob binary")
    union, _ = blocks.frequent_keys(found, -(-min_count // shards), buckets)
    # Whatever the words in between, a phrase is its words one blank apart: they hold none themselves.
    counted = rows.mapInArrow(_count_candidates(union, buckets), "bucket bigint, langs array<string>, blob binary")
    return counted.groupBy("bucket").applyInArrow(_sum_bucket(min_count), COUNTED)


def _times(*factors: Column) -> Column:
    out = F.lit(1).cast("decimal(38,0)")
    for x in factors:
        out = (out * x.cast("decimal(38,0)")).cast("decimal(38,0)")
    return out


def _score(a: Column, left: Column, right: Column) -> Column:
    return F.call_function("div", _times(F.lit(UNIT), a, a), _times(left, right)).cast("bigint")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of 2 and 3 words, each by its worst cut, and whether a longer one covers it."""
    word = lambda i: F.split("phrase", " ")[i]
    part = lambda side: counts.where("size between 1 and 2").select("lang", F.col("phrase").alias(side), F.col("n").alias(f"n_{side}"))
    phrases = counts.where("size in (2, 3)").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = phrases.select("*", F.explode(F.when(F.col("size") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("k"))
    pair = lambda i: F.concat_ws(" ", word(i), word(i + 1))
    cuts = cuts.select(
        "*", F.when(F.col("k") == 1, word(0)).otherwise(pair(0)).alias("head"),
        F.when(F.col("size") == F.col("k") + 1, word(F.col("k"))).otherwise(pair(1)).alias("rest"),
    )
    cuts = cuts.join(part("head").hint("merge"), ["lang", "head"]).join(part("rest").hint("merge"), ["lang", "rest"])
    cut = F.struct(_score(F.col("a"), F.col("n_head"), F.col("n_rest")).alias("score"), "k", F.col("n_head").alias("l"), F.col("n_rest").alias("r"))
    worst = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(cut).alias("cut"))
    covers = phrases.where("size = 3").select("lang", "a", F.explode(F.array(pair(0), pair(1))).alias("phrase"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    out = worst.join(covers.hint("merge"), ["lang", "phrase"], "left")
    covered = F.coalesce(_times(F.col("longer"), F.lit(COVER[1])) >= _times(F.col("a"), F.lit(COVER[0])), F.lit(False))
    return out.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", covered.alias("covered"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, per_lang: int = PER_LANG, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language that no longer one covers."""
    counts = staged(phrase_counts(docs, min_count, shards), "phrases")
    kept = scored(counts).where("not covered").drop("covered")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = kept.withColumn("_salt", salt).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
    best = first.where(F.col("_place") <= per_lang).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    words = counts.where("size = 0").select("lang", "n")
    best = best.where(F.col("rank") <= per_lang).join(words, "lang")
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
