"""Totals, throughput and summaries over rendered rows (M1-M7).

Input rows carry ``n_bytes`` and a status (or level).  Every operator is a
mergeable sum, so Catalyst plans partial and final aggregation and hot groups
are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..session import cut_lineage
from .scan import Scan
from .spikes import repeat_numbers

# Reporting interval and the throughput target in MB/s.
INTERVAL_MS = 500
TARGET_MB_PER_S = 1000.0


def is_error(status_col: str = "status") -> Column:
    """Errors are counted on the emitted rows (status 4xx or 5xx)."""
    return F.col(status_col) >= 400


def is_error_level(level_col: str = "level") -> Column:
    """For syslog rows: levels ERROR and FATAL."""
    return F.col(level_col).isin("ERROR", "FATAL")


def is_error_line(fmt_col: str = "fmt", status_col: str = "status", level_col: str = "syslog_level") -> Column:
    """Errors of a table of mixed formats, by what each line shows: a level for syslog, a status otherwise."""
    return F.when(F.col(fmt_col) == "syslog", is_error_level(level_col)).otherwise(is_error(status_col))


def _sums(error: Column) -> list[Column]:
    return [
        F.count("*").alias("logs"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(error.cast("bigint")), F.lit(0)).alias("errors"),
    ]


def totals(df: DataFrame, error: Column | None = None) -> DataFrame:
    return df.agg(*_sums(is_error() if error is None else error))


def by_state(df: DataFrame, cols: Sequence[str], error: Column | None = None) -> DataFrame:
    """Totals per segment, spike state, format or any other columns (M7)."""
    return df.groupBy(*cols).agg(*_sums(is_error() if error is None else error))


def throughput(
    df: DataFrame, ts_col: str, every_ms: int = INTERVAL_MS, error: Column | None = None, by: Sequence[str] = (), dense: bool = False
) -> DataFrame:
    """Counts and rates per tumbling interval, of all rows or of each group in ``by`` (M2).

    Intervals without rows are absent unless ``dense``: then every interval from
    a group's first to its last one has a row.  The sums are then written once and
    read back, so that no later step makes the rows of ``df`` again.
    """
    ms = F.unix_millis(F.col(ts_col).cast("timestamp"))
    out = df.withColumn("bucket", F.floor(ms / F.lit(every_ms))).groupBy(*by, "bucket").agg(*_sums(is_error() if error is None else error))
    if dense:
        out = without_holes(cut_lineage(out), by)
    seconds = F.lit(every_ms / 1000.0)
    return out.withColumns(
        {
            "logs_per_s": F.col("logs") / seconds,
            "mb_per_s": F.col("bytes") / seconds / F.lit(float(V.MIB)),
        }
    )


def without_holes(buckets: DataFrame, by: Sequence[str] = (), block: int = 1 << 16) -> DataFrame:
    """Rows of zeros for the intervals between those that are there.

    Each interval makes the empty ones since the one before it, dealt over the
    cluster in blocks: a long pause does not expand in one task.
    """
    out = Scan(by, "bucket", block).apply(buckets, previous={"_before": ("last", F.col("bucket"))})
    gap = F.col("bucket") - F.coalesce(F.col("_before"), F.col("bucket") - 1)
    out = repeat_numbers(out, gap, "_back", spread_by=[*by, "bucket"])
    counted = {c: F.when(F.col("_back") == 0, F.col(c)).otherwise(F.lit(0)).cast("bigint") for c in ("logs", "bytes", "errors")}
    return out.withColumns({**counted, "bucket": F.col("bucket") - F.col("_back")}).drop("_back", "_before")


def running_totals(buckets: DataFrame, by: Sequence[str] = (), block: int = 1 << 16) -> DataFrame:
    """Running totals per group in blocks of ``block`` intervals; an interval without rows repeats those before it."""
    return Scan(by, "bucket", block).apply(
        buckets, running={"total_logs": ("sum", F.col("logs")), "total_bytes": ("sum", F.col("bytes"))}
    )


def cumulative(buckets: DataFrame, every_ms: int = INTERVAL_MS, block: int = 1 << 16, start_bucket: int | None = None) -> DataFrame:
    """Running totals and the average since the first interval (M3).

    The scan runs in blocks of ``block`` intervals, so a long run does not end
    in one task; only one row per block meets in the second pass.
    """
    first = buckets.agg(F.min("bucket")).first()[0] if start_bucket is None else start_bucket
    out = running_totals(buckets, block=block)
    elapsed = (F.col("bucket") - F.lit(first) + 1) * F.lit(every_ms) / F.lit(1000.0)
    total_mb = F.col("total_bytes") / F.lit(float(V.MIB))
    return out.withColumns({"total_mb": total_mb, "avg_mb_per_s": total_mb / elapsed})


def summary(df: DataFrame, ts_col: str, error: Column | None = None) -> DataFrame:
    """One-row report (M4) with the target check (M5); the error share of no rows is 0."""
    ms = F.unix_millis(F.col(ts_col).cast("timestamp"))
    out = df.agg(*_sums(is_error() if error is None else error), ((F.max(ms) - F.min(ms)) / F.lit(1000.0)).alias("duration_s"))
    seconds = F.nullif(F.col("duration_s"), F.lit(0.0))
    out = out.withColumns(
        {
            "total_mb": F.col("bytes") / F.lit(float(V.MIB)),
            "total_gb": F.col("bytes") / F.lit(float(V.MIB) * 1024.0),
            "avg_logs_per_s": F.col("logs") / seconds,
            "error_pct": F.when(F.col("logs") > 0, F.col("errors") / F.col("logs") * F.lit(100.0)).otherwise(F.lit(0.0)),
        }
    )
    out = out.withColumn("avg_mb_per_s", F.col("total_mb") / seconds)
    return out.withColumn("target_met", target_met(F.col("avg_mb_per_s")))


def target_met(mb_per_s: Column, target: float = TARGET_MB_PER_S) -> Column:
    return F.coalesce(mb_per_s >= F.lit(target), F.lit(False))
