"""Spike definitions to spike instances (S8-S11) and enter/exit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.draws import Draws

# A spike without error rate has 0.5, without multiplier 1.0.
DEFAULT_SPIKE_ERROR = 0.5
DEFAULT_LATENCY = 1.0

INSTANCE_KEYS = ["scenario_id", "spike_idx", "rep"]
CHUNK = 65_536


def repeat_numbers(
    df: DataFrame, count: Column, name: str, chunk: int = CHUNK, spread_by: list[str] | None = None, parts: int | None = None, block: str | None = None
) -> DataFrame:
    """One row per number 0..count-1; two nested explodes keep every array at most ``chunk`` long.

    ``spread_by`` names the key of the input rows: blocks of ``chunk`` numbers
    are then dealt over the cluster before they expand, so that one row with a
    huge count does not expand in one task.  Only block rows are shuffled, to
    ``parts`` partitions if given.  ``block`` names a column for their number.
    """
    at = block or "_block"
    df = df.withColumn("_count", count).filter(F.col("_count") > 0)
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_count") - 1) / F.lit(chunk)))
    df = df.withColumn(at, F.explode(blocks))
    if spread_by:
        df = df.repartition(*([parts] if parts else []), *spread_by, at)
    first = F.col(at) * F.lit(chunk)
    last = F.least(first + F.lit(chunk - 1), F.col("_count") - 1)
    return df.withColumn(name, F.explode(F.sequence(first, last))).drop("_count", *([] if block else ["_block"]))


def instance_draws(seed: int, digest: str) -> Draws:
    return Draws(INSTANCE_KEYS, seed, digest, "spike")


def jitter_ms(d: Draws, jitter: Column) -> Column:
    """Uniform whole milliseconds in [-jitter, +jitter], from 60 random bits."""
    wide = d.u32(0, 0) * F.lit(1 << 28) + d.bits(0, 32, 28)
    return F.pmod(wide, jitter * 2 + 1) - jitter


def spike_error(d: Draws, lo: Column, hi: Column) -> Column:
    """Fraction drawn from [lo, hi) percent in FLOAT arithmetic; NULL bounds mean the default."""
    pct = (lo + (d.unit(1, 0) * (hi - lo).cast("float")).cast("float")).cast("float")
    return F.coalesce((pct / F.lit(100)).cast("float"), F.lit(DEFAULT_SPIKE_ERROR).cast("float"))


def expand_spikes(spikes: DataFrame, seed: int = 0, digest: str = "xxhash64") -> DataFrame:
    """One row per spike instance ``[start_ms, end_ms)``.

    Repeats are spaced from the unjittered base; a jittered instance may start
    before ``at``.  The error rate is drawn once per instance.
    """
    d = instance_draws(seed, digest)
    rows = repeat_numbers(spikes, F.coalesce(F.col("rep_count").cast("bigint"), F.lit(1).cast("bigint")), "rep")
    base = F.col("at_ms") + F.col("rep") * F.coalesce("rep_interval_ms", F.lit(0))
    shift = F.when(F.coalesce("rep_jitter_ms", F.lit(0)) > 0, jitter_ms(d, F.col("rep_jitter_ms"))).otherwise(F.lit(0))
    # A repeat block is what switches jitter on.
    shift = F.when(F.col("rep_count").isNull(), F.lit(0)).otherwise(shift)
    rows = rows.withColumn("start_ms", (base + shift).cast("bigint"))
    return rows.select(
        "scenario_id",
        "spike_idx",
        "rep",
        "type",
        "start_ms",
        (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
        spike_error(d, F.col("err_lo"), F.col("err_hi")).alias("error"),
        F.coalesce("lat_mult", F.lit(DEFAULT_LATENCY).cast("float")).alias("latency"),
    )


def trigger_order(instances: DataFrame) -> DataFrame:
    """Instances sorted by trigger time; ties keep script order (a distributed range sort)."""
    return instances.orderBy("scenario_id", "start_ms", "spike_idx", "rep")


def display_type(kind: Column | str) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    out = None
    for name, shown in V.SPIKE_TYPES:
        out = F.when(kind == name, F.lit(shown)) if out is None else out.when(kind == name, F.lit(shown))
    return out


def spike_transitions(instances: DataFrame, meta: DataFrame) -> DataFrame:
    """Enter and exit rows of every instance inside the scenario.

    Derived from the instance table alone: no state is kept per key.  An
    instance already running at the start enters at 0; one still running at the
    end has no exit; zero-length instances never become active.
    """
    clipped = instances.join(meta.select("scenario_id", "total_ms"), "scenario_id").filter(
        (F.col("start_ms") < F.col("end_ms")) & (F.col("end_ms") > 0) & (F.col("start_ms") < F.col("total_ms"))
    )
    edges = F.array(
        F.struct(F.greatest("start_ms", F.lit(0)).alias("at_ms"), F.lit("enter").alias("change")),
        F.struct(F.col("end_ms").alias("at_ms"), F.lit("exit").alias("change")),
    )
    return clipped.select(*INSTANCE_KEYS, "type", "total_ms", F.inline(edges)).filter("at_ms < total_ms").drop("total_ms")
