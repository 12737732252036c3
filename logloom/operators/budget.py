"""Expected logs and bytes per time bucket (S19) and capacity plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from .scan import Scan
from .spikes import repeat_numbers


def rate_area(start: Column, end: Column, ramp_ms: Column, dt_ms: Column) -> Column:
    """Integral of the rate from the segment start over ``dt_ms``, in rate x milliseconds (whole)."""
    inside = F.least(dt_ms, ramp_ms)
    bend = (end - start).cast("double") * inside.cast("double") * inside.cast("double") / (F.lit(2.0) * ramp_ms.cast("double"))
    ramped = start * inside + F.when(ramp_ms > 0, F.floor(bend)).otherwise(F.lit(0).cast("bigint"))
    return ramped + end * (dt_ms - inside)


def row_budget(
    segments: DataFrame,
    bucket_ms: int,
    thin: int = 1,
    longest_ms: int | None = None,
    block: int = 1 << 16,
) -> DataFrame:
    """Rows and bytes per (scenario, bucket): differences of the floored cumulative target.

    ``thin=n`` plans one row out of ``n``.  Rate 0 is a pause and yields 0 rows.
    The target up to the end of a bucket is that of all earlier segments plus
    the area of the one in force.  Segments are summed up once, bucket ends and
    segment starts are merged in time order, and each end takes the segment
    carried to it: no segment is spread over its buckets.  Both sums run in
    blocks of ``block`` buckets unless ``longest_ms``, the longest scenario,
    shows that no scenario has more than that.  Differences of floored sums lose
    no fraction, neither of rows nor of bytes.
    """
    one_block = longest_ms is not None and longest_ms <= bucket_ms * block
    span = None if one_block else 2 * bucket_ms * block
    wide = "decimal(38,0)"

    def area(what: str, dt: Column) -> Column:
        # Bytes x milliseconds exceed 64 bits within months.
        start, end = F.col(f"start_{what}").cast("decimal(20,0)"), F.col(f"end_{what}").cast("decimal(20,0)")
        return rate_area(start, end, F.col("ramp_ms"), dt).cast(wide)

    whole = F.col("hi_ms") - F.col("lo_ms")
    # In units of half a millisecond, so that an end sorts before a segment that starts with it.
    parts = segments.withColumns({"_at": F.col("lo_ms") * 2, "_rows": area("lps", whole), "_bytes": area("bps", whole)})
    before = {f"{c}_before": ("sum", F.col(c)) for c in ("_rows", "_bytes")}
    parts = Scan(["scenario_id"], "_at", span).apply(parts, previous=before)
    fields = ["lo_ms", "start_lps", "end_lps", "start_bps", "end_bps", "ramp_ms", *before]
    parts = parts.select("scenario_id", "_at", F.struct(*fields).alias("_segment"), F.lit(None).cast("bigint").alias("bucket"), F.lit(None).cast("bigint").alias("_end"))
    clocks = segments.groupBy("scenario_id").agg(F.max("hi_ms").alias("total_ms"))
    ends = repeat_numbers(clocks, F.ceil(F.col("total_ms") / F.lit(bucket_ms)), "bucket", spread_by=["scenario_id"])
    end = F.least((F.col("bucket") + 1) * F.lit(bucket_ms), "total_ms")
    ends = ends.select("scenario_id", (end * 2 - 1).alias("_at"), F.lit(None).cast(parts.schema["_segment"].dataType).alias("_segment"), "bucket", end.alias("_end"))
    met = Scan(["scenario_id"], "_at", span).apply(parts.unionAll(ends), running={"_in": ("last", F.col("_segment"))})
    met = met.where(F.col("bucket").isNotNull()).select("scenario_id", "bucket", "_end", "_in.*")
    target = lambda what, name: (F.coalesce(F.col(name), F.lit(0)) + area(what, F.col("_end") - F.col("lo_ms"))).cast(wide)
    floored = lambda c: F.call_function("div", c, F.lit(1000 * thin).cast(wide))
    sums = met.select("scenario_id", "bucket", floored(target("lps", "_rows_before")).alias("_c"), floored(target("bps", "_bytes_before")).alias("_b"))
    sums = Scan(["scenario_id"], "bucket", None if one_block else block).apply(sums, previous={"_pc": ("last", F.col("_c")), "_pb": ("last", F.col("_b"))})
    step = lambda now, earlier: (F.col(now) - F.coalesce(F.col(earlier), F.lit(0))).cast("bigint")
    return sums.select("scenario_id", "bucket", step("_c", "_pc").alias("n_rows"), step("_b", "_pb").alias("n_bytes"))


def capacity_plan(budget: DataFrame, formats: Sequence[str], buckets_per_hour: int = 1) -> DataFrame:
    """Rows and bytes per scenario, format and hour with subtotals (ROLLUP, partial aggregation)."""
    sizes = {name: size for name, size in V.FORMAT_SIZES}
    lines = F.array(*[F.struct(F.lit(f).alias("fmt"), F.lit(sizes[f]).alias("line_bytes")) for f in formats])
    rows = budget.select(
        "scenario_id", F.floor(F.col("bucket") / F.lit(buckets_per_hour)).alias("hour"), "n_rows", F.inline(lines)
    )
    return rows.rollup("fmt", "scenario_id", "hour").agg(
        F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_rows") * F.col("line_bytes")).alias("n_bytes")
    )
