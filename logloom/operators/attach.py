"""Attach scenario state to rows by event time (S12-S18) and inject anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import fields
from ..functions.draws import Draws
from ..session import cut_lineage, require_utc
from .control import Control
from .scan import Scan
from .states import error_fraction, progress_percent, rate_description, rates_at, remaining_ms, state_intervals

# Sizes up to which the state table is inlined as literals or broadcast.
LITERAL_ROWS = 48
BROADCAST_ROWS = 200_000
# Intervals of a scenario up to which those of a bucket travel with the rows planned for it.
CARRIED_ROWS = 256
CARRIED = "_carried"
# Blocks that the clock of the longest scenario is cut into where rows and intervals are merged.
TIME_BLOCKS = 1024

STATE_COLUMNS = [
    "lo_ms", "hi_ms", "total_ms", "seg_lo", "start_lps", "end_lps", "start_bps", "end_bps", "ramp_ms", "base_error",
    "n_active", "spike_error", "latency_multiplier", "unusual", "effective_error", "error_fp",
]


def elapsed_ms(ts: Column | str, origin: Column | str) -> Column:
    """Whole milliseconds from the scenario origin; ``origin`` text is a UTC timestamp literal."""
    require_utc()
    ts = F.col(ts) if isinstance(ts, str) else ts
    start = F.lit(origin).cast("timestamp") if isinstance(origin, str) else origin.cast("timestamp")
    return F.unix_millis(ts.cast("timestamp")) - F.unix_millis(start)


class States:
    """State intervals plus the size checks that choose how rows find theirs.

    Few intervals of one scenario become literals (no join, no exchange).  Up to
    ``BROADCAST_ROWS`` intervals and their bytes are broadcast: a row searches
    the interval starts of its scenario and joins the one interval found.
    Beyond, rows and interval starts are merged in time order: both are cut into
    blocks of (scenario, time), sorted there, and the last start before a row is
    carried along, inside a block and from block to block.  No row carries more
    than its own state, and a hot scenario is cut by time.  However the intervals
    lie on the clock, a row meets one of them.
    """

    def __init__(self, intervals: DataFrame, literal_rows: int = LITERAL_ROWS, broadcast_rows: int = BROADCAST_ROWS):
        self.intervals = intervals
        self.broadcast_rows = broadcast_rows
        self.literals: list | None = None
        head = intervals.limit(literal_rows + 1).collect()
        if len(head) <= literal_rows and len({r["scenario_id"] for r in head}) == 1:
            self.literals = sorted(head, key=lambda r: r["lo_ms"])
        self._small: bool | None = None
        self._most: int | None = None

    @classmethod
    def of(cls, control: Control, seed: int = 0, digest: str = "xxhash64", describe: bool = False, **kw) -> "States":
        """States of a control set; the interval table is written once and read back from there."""
        return cls(cut_lineage(state_intervals(control, seed, digest, describe=describe)), **kw)

    @property
    def columns(self) -> list[str]:
        return STATE_COLUMNS + [c for c in ("active_spikes",) if c in self.intervals.columns]

    # -- literal form ------------------------------------------------------------------------
    def _literal_join(self, df: DataFrame) -> DataFrame:
        rows = self.literals
        types = {f.name: f.dataType for f in self.intervals.schema.fields}
        bounds = [r["lo_ms"] for r in rows]

        def search(lo: int, hi: int) -> Column:
            if hi - lo == 1:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col("t_ms") < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid, hi))

        total = rows[-1]["hi_ms"]
        inside = df.filter((F.col("t_ms") >= bounds[0]) & (F.col("t_ms") < total)).withColumn("_i", search(0, len(rows)))

        def cell(c: str) -> Column:
            values = [r[c] for r in rows]
            if len(set(values)) == 1:
                return F.lit(values[0]).cast(types[c])
            return F.get(F.array(*[F.lit(v) for v in values]).cast(ArrayType(types[c])), F.col("_i"))

        cells = {c: cell(c) for c in self.columns}
        return inside.withColumns(cells).drop("_i")

    # -- broadcast form ----------------------------------------------------------------------
    def _fits(self) -> bool:
        """Whether all intervals may be broadcast: their number, and their text where they hold some."""
        if self._small is None:
            text = F.sum(F.octet_length("active_spikes")) if "active_spikes" in self.intervals.columns else F.lit(0)
            size = self.intervals.agg(F.count("*").alias("n"), F.coalesce(text, F.lit(0)).alias("bytes"), F.max("total_ms").alias("longest")).first()
            # A fixed-width interval takes about 200 bytes; text is counted.
            self._small = size["n"] <= self.broadcast_rows and size["bytes"] <= 200 * self.broadcast_rows
            self._longest = size["longest"] or 0
            if self._small:
                self._longest_script()
        return self._small

    def _search_join(self, df: DataFrame, scenario: Column) -> DataFrame:
        """Each row finds its one interval: a binary search in the starts of its scenario, then an equi-join."""
        rows = df.withColumn("_sid", scenario.cast("string"))
        intervals = self.intervals.withColumnRenamed("scenario_id", "_sid")
        starts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "lo_ms"))), lambda g: g["lo_ms"])
        rows = rows.join(F.broadcast(intervals.groupBy("_sid").agg(starts.alias("_starts"))), "_sid")
        rows = _search(rows, "_place", F.col("_starts"), self._most).drop("_starts")
        entry = intervals.select("_sid", (F.col("rank") - 1).alias("_place"), F.struct(*self.columns).alias("_item"))
        rows = rows.join(F.broadcast(entry), ["_sid", "_place"]).drop("_sid", "_place")
        return self._inside(rows)

    # -- merge form --------------------------------------------------------------------------
    def _merge_join(self, df: DataFrame, scenario: Column) -> DataFrame:
        """Each row takes the state of the last interval start that is not after it."""
        none = lambda like: F.lit(None).cast(like.schema[0].dataType)
        starts = self.intervals.select(F.struct(*self.columns).alias("_item"), "scenario_id", "lo_ms")
        rows = df.select(F.struct(*df.columns).alias("_row"), scenario.cast("string").alias("_sid"))
        # A start sorts before the rows of its own millisecond.
        at = (F.col("_row.t_ms") * 2 + 1).cast("bigint").alias("_at")
        both = rows.where(F.col("_row.t_ms").between(0, F.lit(self._longest))).select("_sid", at, "_row", none(starts).alias("_item"))
        both = both.unionAll(starts.select(F.col("scenario_id").alias("_sid"), (F.col("lo_ms") * 2).cast("bigint").alias("_at"), none(rows).alias("_row"), "_item"))
        span = max(1, 2 * self._longest // TIME_BLOCKS)
        merged = Scan(["_sid"], "_at", span).apply(both, running={"_held": ("last", F.col("_item"))})
        merged = merged.where(F.col("_row").isNotNull() & F.col("_held").isNotNull())
        return self._inside(merged.select("_row.*", F.col("_held").alias("_item")))

    # -- carried form ------------------------------------------------------------------------
    def in_buckets(self, plan: DataFrame, bucket_ms: int) -> tuple[DataFrame, list[str]]:
        """Give planned buckets the intervals that they meet, so that the rows made from them need no lookup.

        ``plan`` has a row per (``scenario_id``, ``bucket``); it comes back with the names of the columns
        added, which the rows must keep.  There are none where the intervals are broadcast, or where a
        scenario has more than ``CARRIED_ROWS`` of them: rows then find theirs as any others do.
        """
        if self._fits() or self._longest_script() > CARRIED_ROWS:
            return plan, []
        items = self.intervals.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct(*self.columns))).alias(CARRIED))
        start, end = F.col("bucket") * F.lit(bucket_ms), (F.col("bucket") + 1) * F.lit(bucket_ms)
        met = F.filter(CARRIED, lambda item: (item["lo_ms"] < end) & (item["hi_ms"] > start))
        return plan.join(items, "scenario_id").withColumn(CARRIED, met), [CARRIED]

    def _longest_script(self) -> int:
        if self._most is None:
            self._most = self.intervals.groupBy("scenario_id").count().agg(F.max("count")).first()[0] or 1
        return self._most

    def _carried_join(self, df: DataFrame) -> DataFrame:
        """Each row takes the last of its carried intervals that began."""
        begun = F.filter(CARRIED, lambda item: item["lo_ms"] <= F.col("t_ms"))
        return self._inside(df.withColumn("_item", F.try_element_at(begun, F.lit(-1))).drop(CARRIED))

    def _inside(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumns({c: F.col("_item")[c] for c in self.columns}).drop("_item")
        return out.filter((F.col("t_ms") >= F.col("lo_ms")) & (F.col("t_ms") < F.col("hi_ms")))

    def _join(self, df: DataFrame, scenario: Column) -> DataFrame:
        return self._search_join(df, scenario) if self._fits() else self._merge_join(df, scenario)

    def attach(self, df: DataFrame, ts_col: str, origin: Column | str, scenario_col: str | None = None) -> DataFrame:
        rows = df.withColumn("t_ms", elapsed_ms(ts_col, origin))
        if self.literals is not None and scenario_col is None:
            return self._literal_join(rows)
        if scenario_col is not None and CARRIED in df.columns:
            return self._carried_join(rows)
        if scenario_col is not None:
            return self._join(rows, F.col(scenario_col))
        ids = self.intervals.select("scenario_id").distinct().limit(2).collect()
        if len(ids) > 1:
            raise ValueError("several scenarios: name the column that holds each row's scenario id")
        return self._join(rows, F.lit(ids[0]["scenario_id"] if ids else None))


def _search(df: DataFrame, name: str, starts: Column, most: int) -> DataFrame:
    """Add ``name``: the place of the last of up to ``most`` ascending ``starts`` that is not after ``t_ms`` (0 if none)."""
    steps = [1 << k for k in reversed(range(max(0, most - 1).bit_length()))]
    if not steps:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    # One expression: a chain of columns would be copied into every inferred filter.
    further = lambda at, step: F.get(starts, (at + step).cast("int")) <= F.col("t_ms")
    halve = lambda at, step: F.when(further(at, step), at + step).otherwise(at)
    return df.withColumn(name, F.aggregate(F.array(*[F.lit(x).cast("bigint") for x in steps]), F.lit(0).cast("bigint"), halve))


def attach_scenario(
    df: DataFrame,
    states: States,
    ts_col: str,
    origin: Column | str,
    scenario_col: str | None = None,
) -> DataFrame:
    """Rows inside ``[0, total)`` with the scenario state at their own event time.

    The state is taken at the exact event time of each row, not sampled once
    per batch or clock tick.  Adds: ``t_ms``, ``lps``, ``bps``, ``ramping``,
    ``base_error``, ``spike_active``, ``n_active``, ``spike_error``,
    ``latency_multiplier``, ``unusual``, ``effective_error``, ``error_fp``,
    ``error_rate``, ``progress_pct``, ``remaining_ms``, ``rate_desc`` and the
    interval and segment starts ``lo_ms`` and ``seg_lo``.
    """
    out = rates_at(states.attach(df, ts_col, origin, scenario_col))
    t, total = F.col("t_ms"), F.col("total_ms")
    out = out.withColumns(
        {
            "spike_active": F.col("n_active") > 0,
            "error_rate": error_fraction(F.col("error_fp")),
            "progress_pct": progress_percent(t, total),
            "remaining_ms": remaining_ms(t, total),
            "rate_desc": rate_description(F.col("bps"), F.col("ramping")),
        }
    )
    return out.drop("hi_ms", "start_lps", "end_lps", "start_bps", "end_bps", "ramp_ms")


def inject_anomalies(
    df: DataFrame,
    keys: Sequence[str],
    seed: int = 0,
    digest: str = "xxhash64",
    duration_col: str | None = None,
    apply_latency: bool = False,
) -> DataFrame:
    """Draw a status per row at its error rate and flag anomalies.

    Rows come from :func:`attach_scenario`.  ``apply_latency=True`` multiplies
    ``duration_col`` (or the drawn duration) by the spike's multiplier while a
    latency effect is active; off, durations stay as drawn.
    """
    kept = df.columns
    out, d = Draws(keys, seed, digest).materialize(df, 4)
    out = out.withColumn("status", fields.http_status(d, F.col("error_rate")))
    base = F.col(duration_col) if duration_col else fields.duration_ms_for(d, F.col("status"))
    slow = F.col("spike_active") & (F.col("latency_multiplier") > 0)
    factor = F.when(slow, F.col("latency_multiplier").cast("double")).otherwise(F.lit(1.0))
    duration = F.floor(base.cast("double") * factor).cast("bigint") if apply_latency else base.cast("bigint")
    out = out.withColumns(
        {"_duration": duration, "is_error": F.col("status") >= 400, "is_unusual": F.col("unusual")}
    )
    new = [c for c in ("status", "is_error", "is_unusual") if c not in kept]
    return out.select(*[c for c in kept if c != "duration_ms"], *new, F.col("_duration").alias("duration_ms"))
