"""Control tables of one or many scenarios, and the size checks on them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import SPAN

META_SCHEMA = "scenario_id string, name string, total_ms bigint, format string"
TIMELINE_SCHEMA = (
    "scenario_id string, idx bigint, at_ms bigint, rate_name string, lps bigint, mb int, ramp_ms bigint, error_pct float"
)
SPIKES_SCHEMA = (
    "scenario_id string, spike_idx bigint, at_ms bigint, type string, dur_ms bigint, err_lo float, err_hi float, "
    "lat_mult float, rep_count bigint, rep_interval_ms bigint, rep_jitter_ms bigint"
)
RATES_SCHEMA = "scenario_id string, rate_name string, mb int, lps bigint"


@dataclass(frozen=True)
class Control:
    """Scenario scripts as four DataFrames keyed by ``scenario_id``.

    ``rates`` holds preset overrides only; ``None`` means defaults everywhere.
    ``idx`` and ``spike_idx`` keep the script order and are unique per scenario.
    """

    meta: DataFrame
    timeline: DataFrame
    spikes: DataFrame
    rates: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> "Control":
        return replace(self, **tables)


@dataclass(frozen=True)
class Bound:
    """Largest number of control rows any one scenario expands to."""

    rows: int
    span_rows: int = SPAN

    @property
    def small(self) -> bool:
        return self.rows <= self.span_rows

    @property
    def idx_span(self) -> int | None:
        return None if self.small else self.span_rows

    @property
    def levels(self) -> int:
        return max(1, (2 * self.rows + 4).bit_length())


def control_bound(control: Control, span_rows: int = SPAN) -> Bound:
    """Count events plus spike instances per scenario (partial sums, one number back)."""
    events = control.timeline.groupBy("scenario_id").agg(F.count("*").alias("n"))
    spikes = control.spikes.groupBy("scenario_id").agg(F.sum(F.coalesce("rep_count", F.lit(1))).alias("n"))
    top = (
        events.unionByName(spikes).groupBy("scenario_id").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first()
    )
    return Bound(int(top["n"] or 0) + 1, span_rows)
