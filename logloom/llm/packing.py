"""Best-fit packing of documents into sequences by best-two-fit.

A sequence is filled greedily, longest fitting piece first.  If a gap stays, its smallest piece is
taken out again and replaced by the two unpacked pieces that fit the larger gap most tightly, as
often as that helps.  Pieces of one length are alike, so the fill works on counts by length: a
pattern of lengths is repeated as often as the counts allow, which gives what filling one sequence
after another gives.  The counts are at most ``LIMIT`` numbers, and each pattern uses up a length,
so the plan is small however many documents there are; it is the only thing that leaves Spark.

Tokenising is one narrow pass that also numbers the pieces of each length inside its partition;
adding the counts of earlier partitions gives every piece its number, and the plan its place.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they
occur; an empty table gives an empty result; a null ``doc_id`` stays null; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import Encoder

LIMIT, END = 2048, 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, turn bigint"


def pieces_of(ids: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces: all of ``limit``, but for a shorter first one."""
    first = len(ids) % limit or limit
    yield 0, min(first, len(ids))
    for start in range(first, len(ids), limit):
        yield start, limit


def tokenize(docs: DataFrame, limit: int = LIMIT, end: int = END, file: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece, with ``turn``: its number among the pieces of its length in partition ``part``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, seen = Encoder(file, ranks), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encoder.encode(text), np.uint32(end)).astype("<u4")
                for piece, (start, length) in enumerate(pieces_of(ids, limit)):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(cut, PIECES)


class Plan:
    """Patterns of lengths for the given counts."""

    def __init__(self, counts: dict[int, int], limit: int = LIMIT):
        self.limit = limit
        self.left = np.zeros(limit + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first number, use, first sequence, offset
        self.sequences = 0
        placed = np.zeros(limit + 1, np.int64)
        while (top := int(np.flatnonzero(self.left).max(initial=0))) > 0:
            use = self._tighten(self._fill(top))
            times = min(int(self.left[length]) // n for length, n in use.items())
            offset = 0
            for length, n in sorted(use.items(), reverse=True):
                self.rows.append((length, int(placed[length]), n, self.sequences, offset))
                placed[length] += n * times
                self.left[length] -= n * times
                offset += length * n
            self.sequences += times

    def _free(self, use: Counter) -> np.ndarray:
        free = self.left.copy()
        for length, n in use.items():
            free[length] -= n
        return free

    def _fill(self, top: int) -> Counter:
        use, gap = Counter({top: 1}), self.limit - top
        free = self._free(use)
        while gap:
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            n = min(int(free[length]), gap // length)
            use[length] += n
            free[length] -= n
            gap -= n * length
        return use

    def _tighten(self, use: Counter) -> Counter:
        gap = self.limit - sum(length * n for length, n in use.items())
        while gap and sum(use.values()) > 1:
            small = min(use)
            free = self._free(use)
            pair = self._pair(free, small, gap + small)
            if pair is None:
                break
            use[small] -= 1
            use += Counter()  # drops zero counts
            use.update(pair)
            gap += small - sum(pair)
        return use

    @staticmethod
    def _pair(free: np.ndarray, above: int, room: int) -> tuple[int, int] | None:
        """Two free pieces whose sum is the largest within ``above < sum <= room``."""
        for total in range(room, max(above, 1), -1):
            a = np.arange(1, total // 2 + 1)
            ok = (free[a] > 0) & (free[total - a] > 0)
            if total % 2 == 0:
                ok[-1] = free[total // 2] > 1
            hit = np.flatnonzero(ok)
            if len(hit):
                return int(a[hit[-1]]), int(total - a[hit[-1]])
        return None


def place(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add sequence_id and offset to the (materialised) pieces of :func:`tokenize`."""
    counts = staged(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    rows = np.array(sorted(Plan(totals, limit).rows), np.int64).reshape(-1, 5)
    plan = pieces.sparkSession.sparkContext.broadcast(rows)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def locate(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        table, length, number = plan.value, length.to_numpy(np.int64), number.to_numpy(np.int64)
        wide = int(table[:, 1].max()) + 1 + (int(number.max()) if len(number) else 0)
        at = np.searchsorted(table[:, 0] * wide + table[:, 1], length * wide + number, side="right") - 1
        inside, use = number - table[at, 1], table[at, 2]
        return pd.DataFrame({"sequence_id": table[at, 3] + inside // use, "offset": table[at, 4] + inside % use * length})

    numbered = pieces.join(base.hint("merge"), ["length", "part"])
    spot = numbered.withColumn("spot", locate(F.col("length"), F.col("turn") + F.col("base")))
    return spot.select("doc_id", "piece", "start", "length", "ids_crc32", "spot.sequence_id", "spot.offset")


def pack_documents(docs: DataFrame, limit: int = LIMIT, end: int = END, file: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place(staged(tokenize(docs, limit, end, file, ranks), "pieces"), limit)
