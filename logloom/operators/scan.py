"""Ordered running values per key that never need a whole hot key in one task.

A plain window puts all rows of one key into one task.  When a size check says
a key may be large, the order column is cut into blocks of ``span`` values: the
window runs per (key, block), a second window runs over one summary row per
block, and the block's carry-in is joined back.  Order values are unique within
a key, so a block holds at most ``span`` rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 20


class Scan:
    def __init__(self, keys: Sequence[str], order: str, span: int | None = None):
        self.keys, self.order, self.span = list(keys), order, span

    def apply(
        self,
        df: DataFrame,
        running: Mapping[str, tuple[str, Column]] | None = None,
        previous: Mapping[str, tuple[str, Column]] | None = None,
        following: Mapping[str, Column] | None = None,
    ) -> DataFrame:
        """Add running columns.

        ``running`` values include the current row, ``previous`` values stop
        before it; each is ``name -> (kind, column)`` with kind ``max``, ``sum``
        or ``last`` (last non-null).  ``following`` takes columns from the next row.
        """
        specs = [(n, k, c, 0) for n, (k, c) in (running or {}).items()]
        specs += [(n, k, c, -1) for n, (k, c) in (previous or {}).items()]
        if self.span is None:
            base = Window.partitionBy(*self.keys).orderBy(self.order)
            cols = {n: _over(k, c, base.rowsBetween(Window.unboundedPreceding, end)) for n, k, c, end in specs}
            cols |= {n: F.lead(c).over(base) for n, c in (following or {}).items()}
            return df.withColumns(cols)
        return self._blocked(df, specs, dict(following or {}))

    def _blocked(self, df: DataFrame, specs: list, following: dict[str, Column]) -> DataFrame:
        df = df.withColumn("_blk", F.floor(F.col(self.order) / F.lit(self.span)).cast("bigint"))
        inside = Window.partitionBy(*self.keys, "_blk").orderBy(self.order)
        across = Window.partitionBy(*self.keys).orderBy("_blk")
        totals = [_total(k, c, self.order).alias(f"_t{i}") for i, (_, k, c, _) in enumerate(specs)]
        totals += [F.min_by(c, self.order).alias(f"_f{i}") for i, c in enumerate(following.values())]
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carry = df.groupBy(*self.keys, "_blk").agg(*totals)
        carry = carry.select(
            *self.keys,
            "_blk",
            *[_over(k, F.col(f"_t{i}"), before).alias(f"_c{i}") for i, (_, k, _, _) in enumerate(specs)],
            *[F.lead(f"_f{i}").over(across).alias(f"_a{i}") for i in range(len(following))],
        )
        local = {n: _over(k, c, inside.rowsBetween(Window.unboundedPreceding, end)) for n, k, c, end in specs}
        local |= {n: F.lead(c).over(inside) for n, c in following.items()}
        local["_last"] = F.lead(self.order).over(inside).isNull()
        out = df.withColumns(local).join(carry, [*self.keys, "_blk"])
        merged = {n: _merge(k, F.col(f"_c{i}"), F.col(n)) for i, (n, k, _, _) in enumerate(specs)}
        merged |= {n: F.when(F.col("_last"), F.col(f"_a{i}")).otherwise(F.col(n)) for i, n in enumerate(following)}
        helpers = [f"_c{i}" for i in range(len(specs))] + [f"_a{i}" for i in range(len(following))]
        return out.withColumns(merged).drop("_blk", "_last", *helpers)


def _over(kind: str, c: Column, window: Window) -> Column:
    if kind == "max":
        return F.max(c).over(window)
    if kind == "sum":
        return F.sum(c).over(window)
    return F.last(c, ignorenulls=True).over(window)


def _total(kind: str, c: Column, order: str) -> Column:
    if kind == "max":
        return F.max(c)
    if kind == "sum":
        return F.sum(c)
    return F.max_by(c, F.when(c.isNotNull(), F.col(order)))


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "sum":
        return F.when(carry.isNull(), local).otherwise(carry + F.coalesce(local, F.lit(0)))
    return F.coalesce(local, carry)
