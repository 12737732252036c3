"""Atomic intervals: segments and spike effects cut so that every instant has one state.

All segment and spike boundaries of a scenario cut its clock into intervals,
numbered in time order.  A spike covers a run of consecutive numbers, which
splits into at most ``2 log2 n`` aligned power-of-two blocks.  Effects are first
combined per block (partial aggregation), then every interval reads the blocks
above it, one per level.  Work is ``n log n`` however many spikes overlap; no
spike-by-interval pairs are formed.

Where no scenario expands to more than ``ARRAY_ROWS`` control rows, a scenario's
segments and spikes are two short arrays, and its intervals come out of one
expression over them: one pass, no checkpoint, the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .control import Bound, Control, control_bound
from .scan import Scan
from .spikes import INSTANCE_KEYS, display_type, expand_spikes
from .timeline import STATE, lerp, ramp_progress, timeline_segments

# Blocks of this level and above are read by many intervals; spread them over salts.
SALT_LEVEL, SALTS = 10, 64

# Control rows of a scenario up to which its script is handled as arrays.
ARRAY_ROWS = 256

EFFECT = ["n_active", "spike_error", "latency_multiplier", "unusual"]


# -- S14, S15, S16: scalar rules --------------------------------------------------------------
def effective_error(base: Column, spike: Column, active: Column) -> Column:
    return F.when(active, F.greatest(base, spike)).otherwise(base)


def quantize_error(rate: Column) -> Column:
    """Error rate in 1/10000, truncated after a single-precision product; not below 0."""
    scaled = (rate.cast("float") * F.lit(10000.0).cast("float")).cast("float")
    return F.greatest(scaled.cast("int"), F.lit(0))


def error_fraction(fp: Column) -> Column:
    return (fp.cast("float") / F.lit(10000.0).cast("float")).cast("float")


def controller_fixed_point(rate: Column, latency: Column) -> tuple[Column, Column]:
    """Clamped form: error 0..1 in 1/10000, latency multiplier in 1/100 (never below 0)."""
    f = lambda x: F.lit(x).cast("float")
    error = F.least(F.greatest(rate.cast("float"), f(0.0)), f(1.0))
    scaled = (latency.cast("float") * f(100.0)).cast("float")
    return quantize_error(error), F.greatest(scaled.cast("int"), F.lit(0))


def seconds_f32(ms: Column) -> Column:
    rest = ms % F.lit(1000)
    whole = ((ms - rest) / F.lit(1000.0)).cast("float")
    nanos = (rest * F.lit(1_000_000)).cast("float")
    return whole + (nanos / F.lit(1e9).cast("float")).cast("float")


def progress_percent(elapsed_ms: Column, total_ms: Column) -> Column:
    share = (seconds_f32(elapsed_ms) / seconds_f32(total_ms)).cast("float")
    hundred = F.lit(100.0).cast("float")
    return F.least((share * hundred).cast("float"), hundred)


def remaining_ms(elapsed_ms: Column, total_ms: Column) -> Column:
    return F.greatest(total_ms - elapsed_ms, F.lit(0))


def rate_description(bytes_per_s: Column, ramping: Column) -> Column:
    mb = F.concat(F.floor(bytes_per_s / F.lit(1024 * 1024)).cast("string"), F.lit(" MB/s"))
    return F.when(ramping, F.concat(F.lit("ramping to "), mb)).otherwise(mb)


# -- blocks ----------------------------------------------------------------------------------
def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level)


def cover_blocks(lo: Column, hi: Column) -> Column:
    """Aligned blocks that tile the integer range [lo, hi), as array<struct<level, block>>."""

    def at_level(k: Column) -> Column:
        size = _power(k)
        left = F.floor((lo + size - 1) / size)
        right = F.floor(hi / size)
        open_ = left < right
        one = lambda cond, block: F.when(cond, F.struct(k.alias("level"), block.alias("block")))
        return F.array(
            one(open_ & (left.bitwiseAND(F.lit(1)) == 1), left), one(open_ & (right.bitwiseAND(F.lit(1)) == 1), right - 1)
        )

    levels = F.sequence(F.lit(0), F.length(F.bin(hi - lo)).cast("int"))
    return F.filter(F.flatten(F.transform(levels, at_level)), lambda x: x.isNotNull())


def _salted_blocks(df: DataFrame) -> DataFrame:
    salts = F.when(F.col("level") >= SALT_LEVEL, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("salt", F.explode(salts))


def _ancestors(intervals: DataFrame, levels: int) -> DataFrame:
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    salt = F.when(F.col("level") >= SALT_LEVEL, F.pmod("rank", F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    return intervals.select("scenario_id", "rank", level.alias("level")).select(
        "scenario_id",
        "rank",
        "level",
        F.floor(F.col("rank") / _power(F.col("level"))).alias("block"),
        salt.alias("salt"),
    )


# -- intervals -------------------------------------------------------------------------------
def _clip(instances: DataFrame, meta: DataFrame) -> DataFrame:
    return (
        instances.join(meta.select("scenario_id", "total_ms"), "scenario_id")
        .withColumns({"from_ms": F.greatest("start_ms", F.lit(0)), "to_ms": F.least("end_ms", "total_ms")})
        .filter("from_ms < to_ms")
    )


def cut_intervals(segments: DataFrame, spikes: DataFrame, meta: DataFrame, bound: Bound) -> DataFrame:
    """Numbered boundaries with the segment in force (the end of the clock included)."""
    carried = {"seg_lo": F.col("lo_ms"), **{c: F.col(c) for c in STATE}}
    none = [F.lit(None).cast(t).alias(c) for c, t in segments.select(*[v.alias(c) for c, v in carried.items()]).dtypes]
    cuts = (
        segments.select("scenario_id", F.col("lo_ms").alias("ms"), *[v.alias(c) for c, v in carried.items()])
        .unionByName(meta.select("scenario_id", F.col("total_ms").alias("ms"), *none))
        .unionByName(spikes.select("scenario_id", F.explode(F.array("from_ms", "to_ms")).alias("ms"), *none))
        .groupBy("scenario_id", "ms")
        .agg(*[F.max(c).alias(c) for c in carried])
    )
    scan = Scan(["scenario_id"], "ms", None if bound.small else bound.span_rows)
    cuts = scan.apply(
        cuts,
        running={
            "segment": ("last", F.when(F.col("seg_lo").isNotNull(), F.struct(*carried))),
            "rank": ("sum", F.lit(1).cast("bigint")),
        },
        following={"hi_ms": F.col("ms")},
    )
    return cuts.select("scenario_id", "rank", "ms", "hi_ms", "segment.*")


def _spike_blocks(spikes: DataFrame, cuts: DataFrame) -> DataFrame:
    at = lambda name, ms: cuts.select("scenario_id", F.col("ms").alias(ms), F.col("rank").alias(name))
    ranked = spikes.join(at("r_from", "from_ms"), ["scenario_id", "from_ms"]).join(
        at("r_to", "to_ms"), ["scenario_id", "to_ms"]
    )
    cover = F.inline(cover_blocks(F.col("r_from"), F.col("r_to")))
    return ranked.select(*INSTANCE_KEYS, "type", "start_ms", "error", "latency", cover)


def _array_intervals(segments: DataFrame, spikes: DataFrame, meta: DataFrame, describe: bool) -> DataFrame:
    """The intervals of scenarios with short scripts, from one array of segments and one of spikes each."""
    scripts = segments.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("lo_ms", *STATE))).alias("segs"))
    fields = ["start_ms", "spike_idx", "rep", "from_ms", "to_ms", "error", "latency", "type"]
    waves = spikes.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("waves"))
    rows = meta.select("scenario_id", "total_ms").join(scripts, "scenario_id").join(waves, "scenario_id", "left")
    rows = rows.withColumn("waves", F.coalesce("waves", F.array().cast(waves.schema["waves"].dataType)))
    marks = F.concat(F.transform("segs", lambda s: s["lo_ms"]), F.array("total_ms"), F.transform("waves", lambda w: w["from_ms"]), F.transform("waves", lambda w: w["to_ms"]))
    rows = rows.withColumn("marks", F.array_sort(F.array_distinct(marks)))

    def interval(ms: Column, i: Column) -> Column:
        active = F.filter("waves", lambda w: (w["from_ms"] <= ms) & (ms < w["to_ms"]))
        most = lambda kinds, field: F.array_max(F.transform(F.filter(active, lambda w: w["type"].isin(*kinds)), lambda w: w[field]))
        return F.struct(
            (i + 1).cast("bigint").alias("rank"),
            ms.alias("ms"),
            F.get("marks", i + 1).alias("hi_ms"),
            F.element_at(F.filter("segs", lambda s: s["lo_ms"] <= ms), -1).alias("segment"),
            F.size(active).alias("n"),
            most(("error_burst", "mixed"), "error").alias("e"),
            most(("latency_spike", "mixed"), "latency").alias("l"),
            F.exists(active, lambda w: w["type"] == "unusual_patterns").cast("int").alias("u"),
            *([F.array_join(F.transform(active, lambda w: display_type(w["type"])), ", ").alias("active_spikes")] if describe else []),
        )

    out = rows.select("scenario_id", "total_ms", F.inline(F.transform(F.slice("marks", F.lit(1), F.size("marks") - 1), interval)))
    if describe:
        out = out.withColumn("active_spikes", F.when(F.col("n") == 0, F.lit("none")).otherwise(F.col("active_spikes")))
    state = [F.col(f"segment.{c}").alias(c) for c in STATE]
    return out.select("scenario_id", "total_ms", "rank", "ms", "hi_ms", F.col("segment.lo_ms").alias("seg_lo"), *state, "n", "e", "l", "u", *(["active_spikes"] if describe else []))


def _block_intervals(segments: DataFrame, spikes: DataFrame, meta: DataFrame, bound: Bound, describe: bool) -> DataFrame:
    """The intervals of scripts of any length, with effects combined per block."""
    # Four readers follow; at scale they should not each replay the timeline.
    cuts = cut_lineage(cut_intervals(segments, spikes, meta, bound))
    blocks = _spike_blocks(spikes, cuts)
    errors, latencies = F.col("type").isin("error_burst", "mixed"), F.col("type").isin("latency_spike", "mixed")
    effects = blocks.groupBy("scenario_id", "level", "block").agg(
        F.count("*").alias("n"),
        F.max(F.when(errors, F.col("error"))).alias("e"),
        F.max(F.when(latencies, F.col("latency"))).alias("l"),
        F.max((F.col("type") == "unusual_patterns").cast("int")).alias("u"),
    )
    probes = _ancestors(cuts, bound.levels)
    on = ["scenario_id", "level", "block", "salt"]
    effect = (
        probes.join(_salted_blocks(effects), on)
        .groupBy("scenario_id", "rank")
        .agg(F.sum("n").alias("n"), F.max("e").alias("e"), F.max("l").alias("l"), F.max("u").alias("u"))
    )
    out = cuts.filter(F.col("hi_ms").isNotNull()).join(meta.select("scenario_id", "total_ms"), "scenario_id")
    out = out.join(effect, ["scenario_id", "rank"], "left")
    if describe:
        names = (
            probes.join(_salted_blocks(blocks), on)
            .groupBy("scenario_id", "rank")
            .agg(F.sort_array(F.collect_list(F.struct("start_ms", "spike_idx", "rep", display_type("type").alias("name")))).alias("a"))
            .select("scenario_id", "rank", F.array_join(F.transform("a", lambda x: x["name"]), ", ").alias("active_spikes"))
        )
        out = out.join(names, ["scenario_id", "rank"], "left").withColumn(
            "active_spikes", F.coalesce("active_spikes", F.lit("none"))
        )
    return out


def state_intervals(
    control: Control,
    seed: int = 0,
    digest: str = "xxhash64",
    bound: Bound | None = None,
    describe: bool = False,
    instances: DataFrame | None = None,
    array_rows: int = ARRAY_ROWS,
) -> DataFrame:
    """One row per atomic interval ``[lo_ms, hi_ms)`` with rate parameters and combined effect.

    ``describe=True`` also lists the active spikes by display name in trigger
    order; that output grows with the number of simultaneous spikes.
    """
    bound = bound or control_bound(control)
    segments = timeline_segments(control, bound)
    instances = expand_spikes(control.spikes, seed, digest) if instances is None else instances
    spikes = _clip(instances, control.meta)
    if bound.rows <= array_rows:
        out = _array_intervals(segments, spikes, control.meta, describe)
    else:
        out = _block_intervals(segments, spikes, control.meta, bound, describe)
    # Greatest ignores NULL, and the reduction starts from 0, so no effect reads 0.
    zero = F.lit(0.0).cast("float")
    out = out.withColumns(
        {
            "n_active": F.coalesce("n", F.lit(0)).cast("bigint"),
            "spike_error": F.greatest("e", zero),
            "latency_multiplier": F.greatest("l", zero),
            "unusual": F.coalesce(F.col("u"), F.lit(0)) > 0,
        }
    )
    active = F.col("n_active") > 0
    out = out.withColumn("effective_error", effective_error(F.col("base_error"), F.col("spike_error"), active))
    out = out.withColumn("error_fp", quantize_error(F.col("effective_error")))
    columns = ["scenario_id", "rank", F.col("ms").alias("lo_ms"), "hi_ms", "total_ms", "seg_lo", *STATE, *EFFECT]
    columns += ["effective_error", "error_fp"] + (["active_spikes"] if describe else [])
    return out.select(*columns)


def rates_at(df: DataFrame, t_ms: str = "t_ms") -> DataFrame:
    """Add ``lps``, ``bps`` and ``ramping`` at ``t_ms`` to rows that carry their state."""
    df = df.withColumn("_progress", ramp_progress(F.col("seg_lo"), F.col("ramp_ms"), F.col(t_ms)))
    value = lambda a, b: F.coalesce(lerp(F.col(a), F.col(b), F.col("_progress")), F.col(b))
    return df.withColumns(
        {
            "lps": value("start_lps", "end_lps"),
            "bps": value("start_bps", "end_bps"),
            "ramping": F.col("_progress").isNotNull(),
        }
    ).drop("_progress")
