"""Seeded draws: every random value is a pure function of (seed, row key).

A row owns an unlimited sequence of 64-bit *words*.  Word ``w`` comes from one
of two sources:

* ``xxhash64`` (default): a native long hash, the cheap choice for large runs;
* ``md5``: half of an MD5 digest, four times the cost, but reproducible by any
  SQL engine, so results can be cross-checked.

Fields take fixed bit ranges of a word (offset from the most significant bit).
Nothing depends on partition layout, task order or retries, so a lost executor
recomputes exactly the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGESTS = ("xxhash64", "md5")
# Number of the helper column that holds word 0 of an MD5 digest as a number.
LONG_WORD = 100
# Number of the helper column that holds the keys as text.
KEY_TEXT = 200


class Draws:
    """Words and bit slices for one row key.

    ``words`` optionally maps hash numbers (see :meth:`source_no`) to the names
    of columns that already hold them, ``longs`` maps words to columns that hold
    them as 64-bit numbers; see :meth:`materialize`.
    """

    def __init__(
        self,
        keys: Sequence[Column | str],
        seed: int = 0,
        digest: str = "xxhash64",
        stream: str = "row",
        words: Mapping[int, str] | None = None,
        longs: Mapping[int, str] | None = None,
    ):
        if digest not in DIGESTS:
            raise ValueError(f"digest must be one of {DIGESTS}, got {digest!r}")
        self.keys = [F.col(k) if isinstance(k, str) else k for k in keys]
        self.seed = int(seed)
        self.digest = digest
        self.stream = stream
        self.words = dict(words or {})
        self.longs = dict(longs or {})
        self.key_text: str | None = None
        self._slices: dict[tuple, Column] = {}

    # -- sources -----------------------------------------------------------
    def source_no(self, word: int) -> int:
        """Number of the hash evaluation that holds ``word``."""
        return word // 2 if self.digest == "md5" else word

    def source(self, number: int) -> Column:
        if number in self.words:
            return F.col(self.words[number])
        if self.digest == "md5":
            parts = [F.lit(str(self.seed)), F.lit(self.stream), F.lit(str(number))]
            keys = [k.cast("string") for k in self.keys] if self.key_text is None else [F.col(self.key_text)]
            return F.md5(F.concat_ws("|", *parts, *keys))
        return F.xxhash64(F.lit(self.seed), F.lit(self.stream), F.lit(number), *self.keys)

    def substream(self, stream: str, key: Column) -> "Draws":
        """Draws for a pool entry (shared by all rows that pick that entry)."""
        return Draws([key], self.seed, self.digest, stream)

    def materialize(self, df: DataFrame, n_words: int, prefix: str = "_w", where: Mapping[int, Column] | None = None) -> tuple[DataFrame, "Draws"]:
        """Add the hash columns once, so that many fields share one evaluation.

        Catalyst keeps the extra projection (it does not duplicate expensive
        expressions) and prunes the words no selected field needs.  Hexadecimal
        digests are also turned into numbers once a word, as slices of numbers
        are cheap.  ``where`` may hold a condition for a word: rows that do not
        meet it have no such word (both words of a digest: neither condition).
        """
        where = where or {}
        per = 2 if self.digest == "md5" else 1

        def asked(number: int) -> Column:
            conditions = [where.get(w) for w in range(number * per, min((number + 1) * per, n_words))]
            source = self.source(number)
            return source if any(c is None for c in conditions) else F.when(reduce(or_, conditions), source)

        numbers = sorted({self.source_no(w) for w in range(n_words)})
        if self.digest == "md5" and len(self.keys) > 1:
            # The keys become text once; no key at all leaves no separator either.
            texts = [k.cast("string") for k in self.keys]
            df = df.withColumn(f"{prefix}{KEY_TEXT}", F.when(F.coalesce(*texts).isNotNull(), F.concat_ws("|", *texts)))
            self.key_text = f"{prefix}{KEY_TEXT}"
        df = df.withColumns({f"{prefix}{i}": asked(i) for i in numbers})
        self.key_text = None
        words, longs = {i: f"{prefix}{i}" for i in numbers}, {}
        if self.digest == "md5":
            longs = {w: f"{prefix}{LONG_WORD + w}" for w in range(n_words)}
            number = lambda w: F.expr(f"cast(conv(substring({words[w // 2]}, {1 + 16 * (w % 2)}, 16), 16, -10) as bigint)")
            df = df.withColumns({name: number(w) if where.get(w) is None else F.when(where[w], number(w)) for w, name in longs.items()})
        return df, Draws(self.keys, self.seed, self.digest, self.stream, words, longs)

    # -- slices ------------------------------------------------------------
    def bits(self, word: int, offset: int, width: int) -> Column:
        """Unsigned integer made of ``width`` (<= 32) bits of a word, as BIGINT."""
        if offset % 4 or width % 4 or not 0 < width <= 32 or offset + width > 64:
            raise ValueError("slices are 4-bit aligned, at most 32 bits, inside one word")
        where = (word, offset, width)
        if where not in self._slices:
            self._slices[where] = self._slice(word, offset, width)
        return self._slices[where]

    def _slice(self, word: int, offset: int, width: int) -> Column:
        number = self.source_no(word)
        start, mask = 1 + 16 * (word % 2) + offset // 4, (1 << width) - 1
        if number in self.words:
            # SQL text: one call to the JVM instead of one per operator.
            name = self.longs[word] if self.digest == "md5" else self.words[number]
            return F.expr(f"shiftrightunsigned({name}, {64 - offset - width}) & {mask}L")
        src = self.source(number)
        if self.digest == "md5":
            return F.conv(F.substring(src, start, width // 4), 16, 10).cast("bigint")
        return F.shiftrightunsigned(src, 64 - offset - width).bitwiseAND(F.lit(mask))

    def u8(self, word: int, offset: int) -> Column:
        return self.bits(word, offset, 8)

    def u16(self, word: int, offset: int) -> Column:
        return self.bits(word, offset, 16)

    def u32(self, word: int, offset: int) -> Column:
        return self.bits(word, offset, 32)

    def below(self, word: int, offset: int, n: int, width: int = 32) -> Column:
        """Integer in [0, n)."""
        return self.bits(word, offset, width) % F.lit(n)

    def unit(self, word: int, offset: int) -> Column:
        """FLOAT in [0, 1), a multiple of 2^-24 (exact in single precision)."""
        return (self.bits(word, offset, 24) / F.lit(16777216.0)).cast("float")

    def coin(self, word: int, offset: int) -> Column:
        """BOOLEAN, true half of the time."""
        return self.u8(word, offset) >= 128

    def hex_digits(self, word: int, offset: int, width: int) -> Column:
        """Lower-case hex text of ``width`` bits (up to the whole word)."""
        src = self.source(self.source_no(word))
        if self.digest == "md5":
            return F.substring(src, 1 + 16 * (word % 2) + offset // 4, width // 4)
        value = src if width == 64 else F.shiftrightunsigned(src, 64 - offset - width).bitwiseAND(
            F.lit((1 << width) - 1)
        )
        return F.lower(F.lpad(F.hex(value), width // 4, "0"))


def slot_counts(
    weights: Sequence[tuple[object, int]], total: int | None = None, slots: int = 256, rest: object = None
) -> list[tuple[object, int]]:
    """Slots per value: floor(w * slots / total); left-over slots go to ``rest`` (default: the first value).

    The left-over run is appended at the end, so that value may own two runs.
    """
    total = sum(w for _, w in weights) if total is None else total
    runs = [(value, w * slots // total) for value, w in weights]
    left = slots - sum(n for _, n in runs)
    return runs + ([(weights[0][0] if rest is None else rest, left)] if left else [])


def constant_array(values: Sequence[object]) -> Column:
    """A literal array, built as one folded expression: a lookup costs a few bytecodes.

    Long CASE chains would push the generated method past the size the JVM
    still compiles, which costs far more than the lookup itself.
    """
    first = values[0]
    text = F.split(F.lit("\n".join(str(v) for v in values)), "\n")
    return text if isinstance(first, str) else text.cast("array<int>")


def weighted(
    slot: Column, weights: Sequence[tuple[object, int]], total: int | None = None, slots: int = 256, rest: object = None
) -> Column:
    """Value owning ``slot`` (0-based) under a weight list: a lookup in a table of ``slots`` entries."""
    table = [v for v, n in slot_counts(weights, total, slots, rest) for _ in range(n)]
    return pick(table, slot)


def pick(values: Sequence[object], index: Column) -> Column:
    """Entry of a literal list at a 0-based index."""
    return F.get(constant_array(values), index.cast("int"))


def weighted_slots(dist: DataFrame, value: str, weight: str, slots: int, order: str) -> DataFrame:
    """Slot ranges ``[slot_lo, slot_hi)`` of a distribution table, ordered by ``order``.

    Slots that rounding leaves over go to the first value, be it too rare for a
    slot of its own.  Values without a slot are dropped before the window, so
    it sees at most ``slots`` rows however long the table is.
    """
    from pyspark.sql import Window

    total = dist.agg(F.sum(weight)).first()[0]
    runs = dist.select(
        F.col(value).alias("value"),
        F.col(order).alias("_order"),
        F.floor(F.col(weight) * F.lit(slots) / F.lit(total)).cast("bigint").alias("_n"),
    )
    first = runs.agg(F.min_by("value", "_order").alias("value"), F.coalesce(F.sum("_n"), F.lit(0)).alias("slot_lo"))
    rest = first.withColumn("slot_hi", F.lit(slots).cast("bigint"))
    whole = Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        runs.filter("_n > 0")
        .withColumn("slot_hi", F.sum("_n").over(whole))
        .withColumn("slot_lo", F.col("slot_hi") - F.col("_n"))
    )
    return runs.select("value", "slot_lo", "slot_hi").unionByName(rest).filter("slot_hi > slot_lo and value is not null")


def pool_lookup(df: DataFrame, pool: DataFrame, draw: Column, slot: str = "slot", size: int | None = None,
                broadcast_rows: int = 200_000) -> DataFrame:
    """Attach pool columns to rows by ``draw modulo pool size``.

    ``pool`` has one row per slot 0..n-1.  It is broadcast only when a count
    shows at most ``broadcast_rows`` rows; a larger pool is joined by shuffle
    on the slot (uniform by construction, as the draw is a hash).
    """
    n = pool.count() if size is None else size
    if n <= 0:
        raise ValueError("the pool is empty")
    side = F.broadcast(pool) if n <= broadcast_rows else pool
    keyed = df.withColumn("_slot", F.pmod(draw, F.lit(n)).cast("bigint"))
    side = side.withColumn("_slot", F.col(slot).cast("bigint")).drop(slot)
    return keyed.join(side, "_slot", "left").drop("_slot")
