"""Blocks of texts as word codes, and a fixed-size filter of the keys that occur often enough.

Tasks cut their texts into blocks of about ``BLOCK_BYTES``, find the words with NumPy on the UTF-8
bytes and name each distinct word of a block by a code.  No block depends on another.

The filter answers "may this key reach ``least`` in some shard?".  Every block sends its distinct
keys, cut to the bucket and 32 more bits, as one compressed blob a bucket; a bucket adds up the
counts of each shard and marks the keys that reach the support in its own slice of one bit set.
The set has ``FILTER_BITS`` bits whatever the input (16 MB), so it may be broadcast; a cut or hashed key can only be let
through needlessly, never be lost, and what is let through is counted exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 5 << 20
FILTER_BITS = 1 << 27
BLANKS = b" \t\n\x0b\x0c\r"
PRIME = np.uint64(0x9E3779B97F4A7C15)


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


NOT_BLANK = ~byte_set(BLANKS)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a piece have about BLOCK_BYTES; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
            yield batch.slice(at, stop - at)
            at = stop


class Words(NamedTuple):
    """Words of a list of texts: text i has the words first[i] to first[i + 1]."""

    codes: np.ndarray
    names: pa.Array
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every distinct word."""
        import xxhash

        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.names.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.names))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offsets of its texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def find_words(texts: pa.Array, inside: np.ndarray | Callable[[np.ndarray], np.ndarray] = NOT_BLANK, lower: bool = False) -> Words:
    """Maximal runs of the bytes ``inside`` (a table, or a function of all bytes); A-Z in lower case if asked."""
    offsets, data = utf8(texts)
    within = inside(data) if callable(inside) else inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, closes = within.copy(), within.copy()
    begins[1:] &= ~within[:-1] | edge[1:-1]
    closes[:-1] &= ~within[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    if lower:
        data = LOWER[data]
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[within]))).dictionary_encode()
    return Words(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary, np.searchsorted(starts, offsets), starts, ends, data)


def bucket_count(spark: SparkSession) -> int:
    """Buckets a shuffle deals its blobs to: a power of two, four a shuffle partition or more."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(1 << 16, max(64, 1 << (4 * partitions - 1).bit_length()))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    head = np.array([len(raw), *[len(a) for a in arrays]], np.int64).tobytes()
    return head + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes, *types: type) -> list[np.ndarray]:
    head = np.frombuffer(blob, np.int64, 1 + len(types))
    raw = pa.decompress(memoryview(blob)[8 * len(head) :], int(head[0]), "zstd", asbytes=True) if head[0] else b""
    out, at = [], 0
    for n, kind in zip(head[1:].tolist(), types, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def split_key(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of 64-bit keys and 32 further bits."""
    width = np.uint64(buckets.bit_length() - 1)
    return (keys >> (np.uint64(64) - width)).astype(np.int64), ((keys << width) >> np.uint64(32)).astype(np.uint32)


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Where equal values of a sorted list of numbers from 0 on begin and end."""
    cuts = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=True)) if cuts else []


def key_blobs(keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of distinct sorted keys and their counts."""
    bucket, rest = split_key(keys, buckets)
    for lo, hi in stretches(bucket):
        yield int(bucket[lo]), packed(np.diff(rest[lo:hi], prepend=np.uint32(0)), np.minimum(counts[lo:hi], 2**32 - 1).astype(np.uint32))


def _bits_of(rest: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a key in its bucket's slice of ``width`` bits."""
    key = rest.astype(np.uint64)
    return tuple((mixed((key << np.uint64(i)) + PRIME) & np.uint64(width - 1)).astype(np.int64) for i in (1, 2))


class KeyFilter:
    """The broadcast bit set."""

    def __init__(self, bits: Broadcast, buckets: int):
        self.bits, self.buckets = bits, buckets

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        bits, width = np.frombuffer(self.bits.value, np.uint8), FILTER_BITS // self.buckets
        bucket, rest = split_key(keys, self.buckets)
        out = np.ones(len(keys), bool)
        for place in _bits_of(rest, width):
            at = bucket * width + place
            out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def summed(blobs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (32 bits) of some blobs and the sums of their counts."""
    found = [unpacked(b, np.uint32, np.uint32) for b in blobs]
    rest = np.concatenate([np.cumsum(r, dtype=np.uint32) for r, _ in found])
    counts = np.concatenate([c for _, c in found])
    order = np.argsort(rest)
    rest, counts = rest[order], counts[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(rest.astype(np.int64), prepend=-1))
    return rest[cuts], np.add.reduceat(counts, cuts)


def frequent_keys(blobs: DataFrame, least: int, buckets: int, heavy: int | None = None) -> tuple[KeyFilter, np.ndarray]:
    """(bucket, shard, blob) of all blocks -> the filter of keys that some shard holds ``least`` times.

    Also, where ``heavy`` is given, the keys (bucket and 32 bits in one number) that hold over a
    quarter of their bucket and ``heavy`` occurrences: fewer than four a bucket.
    """
    width = FILTER_BITS // buckets

    def mark(key: tuple, rows: pa.Table) -> pa.Table:
        bits, big = np.zeros(width, np.uint8), []
        shards = rows.column("shard").to_numpy()
        for shard in np.unique(shards):
            rest, counts = summed(rows.filter(pa.array(shards == shard)).column("blob").to_pylist())
            for place in _bits_of(rest[counts >= least], width):
                bits[place] = 1
            if heavy is not None:
                big.append(rest[(counts >= heavy) & (counts * 4 > counts.sum())].astype(np.int64))
        own = np.concatenate(big) if big else np.empty(0, np.int64)
        big = [((key[0].as_py() << 32) | own).tolist()]
        packed_bits = pa.compress(np.packbits(bits, bitorder="little").tobytes(), "zstd", asbytes=True)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([packed_bits], pa.binary()), "heavy": pa.array(big, pa.list_(pa.int64()))})

    rows = blobs.groupBy("bucket").applyInArrow(mark, "bucket bigint, bits binary, heavy array<bigint>").collect()  # at most FILTER_BITS in all
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:
        at = row["bucket"] * (width // 8)
        bits[at : at + width // 8] = np.frombuffer(pa.decompress(bytes(row["bits"]), width // 8, "zstd", asbytes=True), np.uint8)
    large = np.array(sorted(k for row in rows for k in row["heavy"]), np.int64)
    return KeyFilter(blobs.sparkSession.sparkContext.broadcast(bits.tobytes()), buckets), large
