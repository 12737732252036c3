"""Timeline events to non-overlapping rate segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.durations import preset_value
from ..session import cut_lineage
from .control import Bound, Control, control_bound
from .scan import Scan

# A ramp without duration takes 30 s; a run starts with the low preset at 1 % errors.
DEFAULT_RAMP_MS = 30_000
INITIAL_ERROR_PCT = 1.0
FALLBACK_PRESET = "medium"

# A chain of ramps that cut each other is folded in blocks of this many ramps.
CHAIN_BLOCK = 1024

STATE = ["start_lps", "end_lps", "start_bps", "end_bps", "ramp_ms", "base_error"]


# -- S6: value of a linear ramp --------------------------------------------------------------
def seconds_f64(ms: Column) -> Column:
    """Milliseconds as DOUBLE seconds: whole seconds plus nanoseconds / 1e9."""
    rest = ms % F.lit(1000)
    return (ms - rest) / F.lit(1000.0) + (rest * F.lit(1_000_000)) / F.lit(1e9)


def lerp(start: Column, end: Column, progress: Column) -> Column:
    """``start`` plus the share of the distance to ``end``, truncated towards ``start``."""
    return start + ((end - start).cast("double") * progress).cast("bigint")


def ramp_progress(lo_ms: Column, ramp_ms: Column, t_ms: Column) -> Column:
    """Share of a ramp that has passed at ``t_ms``; NULL once it is over (always for flat segments)."""
    waited = t_ms - lo_ms
    return F.when(waited < ramp_ms, seconds_f64(waited) / seconds_f64(ramp_ms))


def ramp_value(start: Column, end: Column, lo_ms: Column, ramp_ms: Column, t_ms: Column) -> Column:
    """Value in force at ``t_ms`` of a ramp that began at ``lo_ms``."""
    return F.coalesce(lerp(start, end, ramp_progress(lo_ms, ramp_ms, t_ms)), end)


# -- S3: presets -----------------------------------------------------------------------------
def resolve_presets(events: DataFrame, rates: DataFrame | None) -> DataFrame:
    """Add ``is_ramp``, ``target_lps`` and ``target_mb``; unknown names fall back to medium.

    Overrides become one wide row per scenario, so the lookup is one equi-join
    on ``scenario_id`` whatever the number of presets.
    """
    is_ramp = F.coalesce(F.col("rate_name").startswith("ramp_to_"), F.lit(False))
    name = F.when(is_ramp, F.substring("rate_name", 9, 1 << 20)).otherwise(F.col("rate_name"))
    df = events.withColumns({"is_ramp": is_ramp, "_name": name})
    found = {"lps": preset_value(F.col("_name"), "lps"), "mb": preset_value(F.col("_name"), "mb")}
    default = {name: {"mb": mb, "lps": lps} for name, mb, lps in V.RATE_PRESETS}
    fallback = {w: F.lit(default[FALLBACK_PRESET][w]).cast("bigint") for w in ("lps", "mb")}
    if rates is not None:
        wide = rates.groupBy("scenario_id").agg(
            *[
                F.max(F.when(F.col("rate_name") == p, F.col(w))).cast("bigint").alias(f"_{w}_{p}")
                for p, _, _ in V.RATE_PRESETS
                for w in ("lps", "mb")
            ]
        )
        df = df.join(wide, "scenario_id", "left")
        for w in ("lps", "mb"):
            for p, _, _ in V.RATE_PRESETS:
                found[w] = F.when(F.col("_name") == p, F.coalesce(F.col(f"_{w}_{p}"), found[w])).otherwise(found[w])
            fallback[w] = F.coalesce(F.col(f"_{w}_{FALLBACK_PRESET}"), fallback[w])
    explicit = F.col("rate_name").isNull()
    return df.select(
        *events.columns,
        "is_ramp",
        F.when(explicit, F.col("lps")).otherwise(F.coalesce(found["lps"], fallback["lps"])).alias("target_lps"),
        F.when(explicit, F.col("mb").cast("bigint")).otherwise(F.coalesce(found["mb"], fallback["mb"])).alias("target_mb"),
    )


# -- S5, S6, S7: segments --------------------------------------------------------------------
def effective_events(control: Control, bound: Bound) -> DataFrame:
    """Events in script order with the time they take effect.

    An event waits for all earlier ones, so its time is the running maximum of
    ``at``.  The initial state is an event before the first one.
    """
    meta = control.meta.select("scenario_id", "total_ms")
    start = meta.select(
        "scenario_id",
        F.lit(-1).cast("bigint").alias("idx"),
        F.lit(0).cast("bigint").alias("at_ms"),
        F.lit("low").alias("rate_name"),
        F.lit(None).cast("bigint").alias("lps"),
        F.lit(None).cast("int").alias("mb"),
        F.lit(None).cast("bigint").alias("ramp_ms"),
        F.lit(INITIAL_ERROR_PCT).cast("float").alias("error_pct"),
    )
    columns = start.columns
    events = resolve_presets(control.timeline.select(*columns).unionByName(start), control.rates)
    events = events.select(
        "scenario_id",
        "idx",
        "at_ms",
        "is_ramp",
        "target_lps",
        (F.col("target_mb") * F.lit(V.MIB)).alias("target_bps"),
        F.when(F.col("is_ramp"), F.coalesce("ramp_ms", F.lit(DEFAULT_RAMP_MS))).otherwise(F.lit(0)).cast("bigint").alias("ramp_ms"),
        (F.col("error_pct") / F.lit(100)).cast("float").alias("error"),
    )
    events = Scan(["scenario_id"], "idx", bound.idx_span).apply(events, running={"eff_ms": ("max", F.col("at_ms"))})
    return events.join(meta, "scenario_id").filter(F.col("eff_ms") < F.col("total_ms"))


def timeline_segments(control: Control, bound: Bound | None = None, chain_block: int = CHAIN_BLOCK) -> DataFrame:
    """One row per non-empty ``[lo_ms, hi_ms)`` with its ramp parameters and base error rate."""
    bound = bound or control_bound(control)
    events = effective_events(control, bound)
    is_set = F.when(~F.col("is_ramp"), F.col("idx"))
    # All events of one instant collapse to the last one, the last immediate
    # value before it, and the last error rate given: partial aggregation, so
    # any number of events may share an instant.
    steps = events.groupBy("scenario_id", "eff_ms").agg(
        F.max("idx").alias("last_idx"),
        F.max("total_ms").alias("total_ms"),
        F.max_by("is_ramp", "idx").alias("is_ramp"),
        F.max_by("target_lps", "idx").alias("end_lps"),
        F.max_by("target_bps", "idx").alias("end_bps"),
        F.max_by("ramp_ms", "idx").alias("ramp_ms"),
        F.max_by("target_lps", is_set).alias("set_lps"),
        F.max_by("target_bps", is_set).alias("set_bps"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("idx"))).alias("error"),
    )
    scan = Scan(["scenario_id"], "last_idx", bound.idx_span)
    state = F.struct("is_ramp", "eff_ms", "end_lps", "end_bps", "ramp_ms")
    steps = scan.apply(
        steps,
        running={"base_error": ("last", F.col("error"))},
        previous={"prev": ("last", state)},
        following={"hi_ms": F.col("eff_ms")},
    )
    waited = F.col("eff_ms") - F.col("prev.eff_ms")
    steps = steps.withColumn(
        "link",
        F.coalesce(
            F.col("is_ramp") & F.col("set_lps").isNull() & F.col("prev.is_ramp") & (waited < F.col("prev.ramp_ms")),
            F.lit(False),
        ),
    )
    steps = steps.select(
        "scenario_id",
        "last_idx",
        F.col("eff_ms").alias("lo_ms"),
        F.coalesce("hi_ms", "total_ms").alias("hi_ms"),
        "total_ms",
        "link",
        "end_lps",
        "end_bps",
        "ramp_ms",
        "base_error",
        F.when(F.col("is_ramp"), F.coalesce("set_lps", "prev.end_lps")).otherwise(F.col("end_lps")).alias("start_lps"),
        F.when(F.col("is_ramp"), F.coalesce("set_bps", "prev.end_bps")).otherwise(F.col("end_bps")).alias("start_bps"),
        F.when(F.col("link"), seconds_f64(waited) / seconds_f64(F.col("prev.ramp_ms"))).alias("progress"),
    )
    return _fold_chains(steps, bound, chain_block).select("scenario_id", "lo_ms", "hi_ms", "total_ms", *STATE)


def _fold_chains(steps: DataFrame, bound: Bound, block: int) -> DataFrame:
    """Start values of ramps that cut a running ramp.

    Such a start depends on the cut ramp's own start, with truncation at every
    step, so a chain of cuts is a left fold.  Chains are folded in blocks of
    ``block`` ramps; a chain longer than one block takes further rounds that
    start from the carried value.
    """
    scan = Scan(["scenario_id"], "last_idx", bound.idx_span)
    steps = scan.apply(
        steps,
        running={"chain": ("last", F.when(~F.col("link"), F.col("last_idx"))), "_n": ("sum", F.lit(1))},
    )
    rounds = 1
    if bound.rows > block:
        steps = scan.apply(steps, running={"_head": ("last", F.when(~F.col("link"), F.col("_n")))})
        steps = cut_lineage(steps.withColumn("_round", F.floor((F.col("_n") - F.col("_head")) / F.lit(block))))
        rounds = int(steps.agg(F.max("_round")).first()[0] or 0) + 1
    fields = [c for c in steps.columns if c not in ("scenario_id", "chain", "_round", "_head", "_n")]
    folded, carry = [], None
    for r in range(rounds):
        part = steps if rounds == 1 else steps.filter(F.col("_round") == r)
        arrays = part.groupBy("scenario_id", "chain").agg(
            F.sort_array(F.collect_list(F.struct("last_idx", *[f for f in fields if f != "last_idx"]))).alias("ramps")
        )
        seeds = [F.lit(None).cast("bigint")] * 4
        if carry is not None:
            arrays = arrays.join(carry, ["scenario_id", "chain"])
            seeds = [F.col(c) for c in ("_x", "_y", "_tx", "_ty")]
        arrays = arrays.withColumn("done", _fold(F.col("ramps"), seeds))
        if r + 1 < rounds:
            last = F.element_at("done", -1)
            tail = F.element_at("ramps", -1)
            carry = cut_lineage(
                arrays.select(
                    "scenario_id", "chain", last["x"].alias("_x"), last["y"].alias("_y"),
                    tail["end_lps"].alias("_tx"), tail["end_bps"].alias("_ty"),
                )
            )
        folded.append(
            arrays.select("scenario_id", F.explode(F.arrays_zip("ramps", "done")).alias("z")).select(
                "scenario_id",
                *[F.col(f"z.ramps.{f}").alias(f) for f in fields if f not in ("start_lps", "start_bps", "link", "progress")],
                F.col("z.done.x").alias("start_lps"),
                F.col("z.done.y").alias("start_bps"),
            )
        )
    return reduce(DataFrame.unionByName, folded)


def _fold(ramps: Column, seeds: list[Column]) -> Column:
    """Array of (x, y) start values: logs/s and bytes/s, folded left to right."""
    x, y, tx, ty = seeds
    empty = F.array().cast("array<struct<x:bigint,y:bigint>>")

    def step(acc: Column, ramp: Column) -> Column:
        cut = ramp["link"]
        new_x = F.when(cut, lerp(acc["x"], acc["tx"], ramp["progress"])).otherwise(ramp["start_lps"])
        new_y = F.when(cut, lerp(acc["y"], acc["ty"], ramp["progress"])).otherwise(ramp["start_bps"])
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(new_x.alias("x"), new_y.alias("y")))).alias("out"),
            new_x.alias("x"),
            new_y.alias("y"),
            ramp["end_lps"].alias("tx"),
            ramp["end_bps"].alias("ty"),
        )

    start = F.struct(empty.alias("out"), x.alias("x"), y.alias("y"), tx.alias("tx"), ty.alias("ty"))
    return F.aggregate(ramps, start, step, lambda acc: acc["out"])
