"""Substring dedup: repeated windows of words found by super-k-mer partitioning.

A window is ``WIDTH`` consecutive words of one document.  The minimiser of a window is the least of
the hashes of its ``GRAM``-word grams; consecutive windows that share it travel as one packed string
(a super-k-mer) to the bucket of the minimiser, so equal windows always meet and a text is not
sent once a window.  A bucket sorts its windows, compares their words and keeps the first of each.

Three things keep the traffic small without changing a result.
First, blocks of documents settle their own repeats, so a passage of a third of all documents is
sent once a block.  Second, minimisers that occur once in the whole corpus cannot hold a repeated
window: all minimisers are counted first and only windows that pass this filter travel
(``blocks.frequent_keys``: a bit set of fixed size, which can only let too much through).  Third,
grams that fill their bucket are ranked behind all others when buckets are dealt, so windows beside
a common phrase go to the buckets of their rarer grams.

Equal windows are ordered by document id, then start.  A window is judged on the input, and words
covered by a window that is not the first of its kind go.

Defined cases: a null or empty text, or one of less than ``WIDTH`` words, loses nothing; a null
``doc_id`` takes no part and keeps its words; rows that repeat a ``doc_id`` are documents of their
own, ordered by a hash of the text, and rows that repeat the text too are one document (all lose
the same words); an empty table gives an empty result; other columns are carried in one struct and
so cannot clash.  A single text is handled whole in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import PRIME, KeyFilter, Words, bucket_count, find_words, mixed, packed, text_blocks, unpacked
from .common import blank

WIDTH, GRAM = 20, 5
#: Windows in one packed string at most, so that a uniform text does not travel as one; occurrences of a common gram.
RUN, HEAVY = 64, 1000
PARTS = "bucket bigint, blob binary"


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values."""
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * PRIME + values[k : k + n]
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:]) if len(values) > reach else values[:0]
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest and len(values) > rest else values[: max(0, len(values) - rest)]


def window_starts(words: Words, width: int) -> np.ndarray:
    """Places of the words at which a window of one document starts."""
    doc = words.text_of()
    n = max(0, len(doc) - width + 1)
    return np.flatnonzero(doc[:n] == doc[len(doc) - n :])


def repeats_of(codes: np.ndarray, hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, earlier places first, and whether each equals the one before it.

    The order is that of the hashes; the words decide, and where two different windows have one hash
    they are sorted by their words instead.
    """
    order = np.argsort(hashes, kind="stable")
    for by_words in (False, True):
        if by_words:
            order = np.lexsort([codes[starts + k] for k in reversed(range(width))])
        same = hashes[order[1:]] == hashes[order[:-1]]
        at = np.flatnonzero(same)
        a, b = starts[order[at]], starts[order[at + 1]]
        for k in range(width):
            same[at] &= codes[a + k] == codes[b + k]
        if by_words or same[at].all():
            return order, np.concatenate([np.zeros(min(1, len(order)), bool), same])
    raise AssertionError


class _Block:
    """The words, window starts and gram hashes of a block of documents, in order of their ids."""

    def __init__(self, batch: pa.RecordBatch, width: int, gram: int):
        ids, rids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "rid"))
        order = np.lexsort((rids, ids))
        same = (np.diff(ids[order]) == 0) & (np.diff(rids[order]) == 0)
        order = order[np.concatenate([np.ones(min(1, len(order)), bool), ~same])]
        self.ids, self.rids = ids[order], rids[order]
        self.words = find_words(batch.column("text").take(pa.array(order)))
        self.values = self.words.hashes()[self.words.codes] if len(self.words.codes) else np.empty(0, np.uint64)
        self.grams = rolled(self.values, gram)
        self.span = width - gram + 1
        self.starts = window_starts(self.words, width)

    def minimisers(self, grams: np.ndarray) -> np.ndarray:
        return sliding_min(grams, self.span)[self.starts] if len(self.starts) else np.empty(0, np.uint64)

    def minimal_grams(self) -> np.ndarray:
        """The hash of every place whose gram is the minimiser of some window; a window that repeats has two such places."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        least = np.zeros(len(self.grams) + self.span - 1, np.uint64)
        least[self.starts + self.span - 1] = self.minimisers(self.grams)
        most = ~sliding_min(~least, self.span)
        return self.grams[(most == self.grams[: len(most)]) & (most > 0)]


def _runs(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs of consecutive windows with one key, RUN windows at most."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.concatenate([[True], (np.diff(starts) != 1) | (keys[1:] != keys[:-1])])
    at = np.arange(len(starts))
    since = at - np.maximum.accumulate(np.where(fresh, at, 0))
    first = np.flatnonzero(fresh | (since % RUN == 0))
    return first, np.diff(first, append=len(starts))


def _minimiser_blobs(buckets: int, width: int, gram: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            block = _Block(batch, width, gram)
            keys, n = np.unique(block.minimal_grams(), return_counts=True)
            rows = list(blocks.key_blobs(keys, n, buckets))
            yield pa.record_batch([pa.array([b for b, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "shard", "blob"])

    return count


def _spans(ids: np.ndarray, rids: np.ndarray, first: np.ndarray, last: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Blobs of word ranges [first, last) of documents; they pass through the buckets after the last one."""
    where = buckets + (mixed(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    for lo, hi in blocks.stretches(where[order]):
        own = order[lo:hi]
        yield int(where[own[0]]), packed(ids[own], rids[own], first[own], last[own])


def _super_kmers(may_repeat: KeyFilter, heavy: np.ndarray, buckets: int, width: int, gram: int):
    """Per block: its own repeats as word ranges, and the first of its windows that may repeat elsewhere, packed by bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            block = _Block(batch, width, gram)
            words, starts = block.words, block.starts
            passes = may_repeat.may_hold(block.minimisers(block.grams))
            starts = starts[passes]
            order, same = repeats_of(words.codes, rolled(block.values, width)[starts], starts, width)
            later = np.zeros(len(starts), bool)
            later[order] = same
            doc = words.text_of()
            rows = []
            own, n = _runs(starts[later], doc[starts[later]])
            at = starts[later][own]
            base = words.first[doc[at]]
            rows += _spans(block.ids[doc[at]], block.rids[doc[at]], at - base, at - base + n + width - 1, buckets)
            # Common grams come last in the order that deals the rest.
            bucket, rest = blocks.split_key(block.grams, may_repeat.buckets)
            common = np.isin((bucket << 32) | rest.astype(np.int64), heavy)
            ranked = (block.grams >> np.uint64(1)) | (common.astype(np.uint64) << np.uint64(63))
            starts = starts[~later]
            keys = sliding_min(ranked, block.span)[starts] if len(starts) else np.empty(0, np.uint64)
            own, n = _runs(starts, keys)
            at = starts[own]
            where = (mixed(keys[own]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            own, n, at, where = own[order], n[order], at[order], where[order]
            base = words.first[doc[at]]
            # The words of a run, one blank apart.
            lengths = words.ends - words.starts
            place = np.concatenate([[0], np.cumsum(lengths + 1)])
            text = np.full(int(place[-1]), 32, np.uint8)
            for_byte = np.repeat(place[:-1] - words.starts, lengths)
            inside = np.flatnonzero(np.repeat(*_inside(words)))
            text[inside + for_byte] = words.data[inside]
            view = memoryview(text)
            parts = [view[a:b] for a, b in zip(place[at].tolist(), place[at + n + width - 1].tolist(), strict=True)]
            for lo, hi in blocks.stretches(where):
                string = np.frombuffer(b"".join(parts[lo:hi]), np.uint8)
                d = doc[at[lo:hi]]
                rows.append((int(where[lo]), packed(block.ids[d], block.rids[d], at[lo:hi] - base[lo:hi], n[lo:hi].astype(np.uint8), string)))
            yield pa.record_batch([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    return send


def _inside(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Alternating false and true stretches of the bytes, as arguments of ``np.repeat``."""
    edges = np.empty(2 * len(words.starts) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = words.starts, words.ends, len(words.data)
    flags = np.zeros(len(edges), bool)
    flags[1::2] = True
    return flags, np.diff(edges, prepend=0)


SPANS = "doc_id bigint, rid bigint, first bigint, last bigint"


def _sort_bucket(buckets: int, width: int):
    """The word ranges of windows that stand earlier in the bucket's order."""

    def table(ids: np.ndarray, rids: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Table:
        return pa.table([pa.array(x.astype(np.int64)) for x in (ids, rids, first, last)], ["doc_id", "rid", "first", "last"])

    def judge(key: tuple, rows: pa.Table) -> pa.Table:
        blobs = rows.column("blob").to_pylist()
        if key[0].as_py() >= buckets:
            parts = [unpacked(b, *[np.int64] * 4) for b in blobs]
            return table(*[np.concatenate(x) for x in zip(*parts, strict=True)])
        parts = [unpacked(b, np.int64, np.int64, np.int64, np.uint8, np.uint8) for b in blobs]
        ids, rids, at, n, _ = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = n.astype(np.int64)
        words = find_words(pa.array([p[4].tobytes().decode() for p in parts], pa.large_string()))
        # Packed strings stand one after the other: each has its windows and width - 1 more words.
        string = np.concatenate([[0], np.cumsum(n + width - 1)])
        ranked = np.lexsort((at, rids, ids))
        ids, rids, at, n, string = ids[ranked], rids[ranked], at[ranked], n[ranked], string[ranked]
        run = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        starts = string[run] + step
        order, same = repeats_of(words.codes, rolled(words.hashes()[words.codes], width)[starts], starts, width)
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        a, b = run[head], run[order]
        # The same place in two equal rows is one window.
        earlier = same & ((ids[a] != ids[b]) | (rids[a] != rids[b]) | (at[a] + step[head] != at[b] + step[order]))
        later = np.zeros(len(run), bool)
        later[order] = earlier
        gone = np.flatnonzero(later)
        fresh = np.diff(gone, prepend=-2) != 1
        fresh[1:] |= run[gone[1:]] != run[gone[:-1]]
        lead = np.flatnonzero(fresh)
        length = np.diff(lead, append=len(gone))
        own = gone[lead]
        first = at[run[own]] + step[own]
        return table(ids[run[own]], rids[run[own]], first, first + length + width - 1)

    return judge


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text) -> doc_id, rid (xxhash64 of the text), spans: ranges of words to remove."""
    buckets = bucket_count(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(blank(F.col("text"))).alias("rid"), "text")
    counted = rows.mapInArrow(_minimiser_blobs(buckets, width, gram), "bucket bigint, shard int, blob binary")
    may_repeat, heavy = blocks.frequent_keys(counted, 2, buckets, HEAVY)
    sent = rows.mapInArrow(_super_kmers(may_repeat, heavy, buckets, width, gram), PARTS)
    spans = sent.groupBy("bucket").applyInArrow(_sort_bucket(buckets, width), SPANS)
    return spans.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def with_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``row`` (all columns of docs) and ``spans``, null where nothing goes."""
    found = repeated_spans(docs, width, gram)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(blank(F.col("text"))).alias("rid"))
    return rows.join(found.hint("merge"), ["doc_id", "rid"], "left").select("row", "spans")


def kept_words(texts: pa.Array, spans: list[list[dict] | None]) -> Iterator[tuple[int, int, bytes]]:
    """Per text: words, removed words, and the kept words joined by one blank."""
    words = find_words(texts)
    cover = np.zeros(len(words.codes) + 1, np.int64)
    for i, own in enumerate(spans):
        for span in own or ():
            cover[words.first[i] + span["first"]] += 1
            cover[words.first[i] + span["last"]] -= 1
    keep = np.cumsum(cover[:-1]) == 0
    data = np.append(words.data, np.uint8(32))
    # A word's bytes and the place after it, which becomes the blank; a word that ends its text has none.
    ends_text = np.isin(words.ends, _ends_of(texts))
    flags, lengths = _inside(words)
    stays = np.repeat(keep, words.ends - words.starts)
    inside = np.flatnonzero(np.repeat(flags, lengths))
    taken = np.zeros(len(data), bool)
    taken[inside[stays]] = True
    blanks = words.ends[keep & ~ends_text]
    taken[blanks] = True
    data[blanks] = 32
    offsets = _ends_of(texts, True)
    kept = data[taken].tobytes()
    at = np.concatenate([[0], np.cumsum(taken)])[offsets].tolist()
    gone = np.concatenate([[0], np.cumsum(~keep)])[words.first].tolist()
    first = words.first.tolist()
    for i in range(len(first) - 1):
        yield first[i + 1] - first[i], gone[i + 1] - gone[i], kept[at[i] : at[i + 1]].removesuffix(b" ")


def _ends_of(texts: pa.Array, with_start: bool = False) -> np.ndarray:
    offsets, _ = blocks.utf8(texts)
    return offsets if with_start else offsets[1:]


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text's SHA-256 of every row; ``with_spans`` has the ranges themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            rows = list(kept_words(batch.column("text"), batch.column("spans").to_pylist()))
            sums = [hashlib.sha256(kept).hexdigest() for _, _, kept in rows]
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
            yield pa.record_batch([batch.column("doc_id"), *counts, pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = with_spans(docs.select("doc_id", "text"), width, gram).select(F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text"), "spans")
    return rows.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
