import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.functions.durations import duration_ms, duration_ok, rate_lps
from logloom.operators.attach import STATE_COLUMNS, States, attach_scenario
from logloom.operators.control import META_SCHEMA, SPIKES_SCHEMA, TIMELINE_SCHEMA, Bound, Control, control_bound
from logloom.operators.scan import Scan
from logloom.operators.spikes import expand_spikes, repeat_numbers, trigger_order
from logloom.operators.states import cover_blocks, quantize_error, state_intervals
from logloom.operators.timeline import timeline_segments
from logloom.plans import fixtures as X

H = X.HOUR


def table(spark, rows, schema):
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in struct.fields]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "float": pa.float32()}
    arrays = [pa.array(list(c), kinds[f.dataType.simpleString()]) for c, f in zip(columns, struct.fields, strict=True)]
    return spark.createDataFrame(pa.table(arrays, names=struct.names))


def random_control(spark, seed, scenarios=4, events=40, spikes=30, total=1_000_000, names=None):
    rng = random.Random(seed)
    names = names or ["low", "full", "nosuch", "ramp_to_full", "ramp_to_low", "ramp_to_max", "ramp_to_x"]
    tl, sp = [], []
    for s in range(scenarios):
        # Scenario 0 is the hot one.
        n = events * 5 if s == 0 else events
        for i in range(n):
            at = rng.randrange(total // 1000) * 1000 if s % 2 else int(total * i / n) + rng.randrange(20_000)
            tl.append((f"s{s}", i, at, rng.choice(names), None, None, rng.choice([None, 5_000, 90_000, 400_000]), rng.choice([None, 0.7, 5.7, 40.0])))
        for i in range(spikes * 5 if s == 0 else spikes):
            kind = rng.choice(["error_burst", "latency_spike", "unusual_patterns", "mixed"])
            count = rng.choice([None, 0, 1, 3])
            sp.append((f"s{s}", i, rng.randrange(total), kind, rng.randrange(200_000), rng.choice([None, 20.0]), rng.choice([80.0, 20.0]), rng.choice([None, 3.0]), count, 50_000, rng.choice([None, 7_000])))
    sp = [(*r[:5], r[5], None if r[5] is None else r[6], *r[7:]) for r in sp]
    meta = [(f"s{s}", f"s{s}", total, None) for s in range(scenarios)]
    return Control(table(spark, meta, META_SCHEMA), table(spark, tl, TIMELINE_SCHEMA), table(spark, sp, SPIKES_SCHEMA))


DURATIONS = {
    "10s": 10_000, "1m": 60_000, "1m30s": 90_000, "2h": 7_200_000, "1h30m": 5_400_000, "1m30": 90_000, "90": 90_000,
    "1.5s": 15_000, "-5s": 5_000, "--": 0, "2H": 7_200_000, "": None, "  ": None, "500ms": None, "5d": None, "s": None,
    "99999999999999999999h": None,
}


def test_durations(spark):
    df = table(spark, [(k,) for k in DURATIONS], "t string")
    got = {r["t"]: r["ms"] for r in df.select("t", duration_ms("t").alias("ms"), duration_ok("t").alias("ok")).collect()}
    assert got == DURATIONS


def test_rates(spark):
    want = {"low": 500_000, "LOW": None, "500K": 500_000, "1m": 1_000_000, "1.5M": None, "7": 7, "M": None, "full": 5_000_000}
    df = table(spark, [(k,) for k in want], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", rate_lps("t").alias("v")).collect()} == want


def test_quantized_in_single_precision(spark):
    rows = [(5.7,), (0.7,), (50.0,), (-3.0,), (150.0,)]
    df = table(spark, rows, "p float").select(quantize_error((F.col("p") / 100).cast("float")).alias("q"))
    assert [r["q"] for r in df.collect()] == [569, 70, 5000, 0, 15000]


def test_month_segments(spark):
    rows = timeline_segments(X.month_control(spark)).orderBy("lo_ms").collect()
    assert [(r["lo_ms"] // H, r["hi_ms"] // H, r["start_lps"], r["end_lps"], r["ramp_ms"] // H) for r in rows] == [
        (0, 48, 500_000, 500_000, 0),
        (48, 60, 500_000, 5_000_000, 24),
        (60, 96, 2_750_000, 500_000, 12),
        (96, 240, 2_500_000, 2_500_000, 0),
        (240, 480, 2_500_000, 2_500_000, 0),
        (480, 500, 0, 0, 0),
        (500, 696, 10_000_000, 10_000_000, 0),
    ]
    assert [round(r["base_error"], 4) for r in rows] == [0.005, 0.005, 0.005, 0.01, 0.057, 0.057, 0.02]


@pytest.mark.parametrize("names", [None, ["ramp_to_full", "ramp_to_low", "ramp_to_max"]])
def test_segments_match_step_by_step_walk(spark, names):
    control = random_control(spark, 7, names=names)
    got = {}
    for r in timeline_segments(control).collect():
        got.setdefault(r["scenario_id"], []).append((r["lo_ms"], r["hi_ms"], r["start_lps"], r["end_lps"], r["ramp_ms"]))
    events = {}
    for r in control.timeline.collect():
        events.setdefault(r["scenario_id"], []).append(r.asDict())
    for sid, rows in events.items():
        assert sorted(got[sid]) == brute.segments(rows, 1_000_000)


def test_blocked_scans_and_chain_rounds_give_the_same_segments(spark):
    """The path for scenarios too large for one task, forced by tiny limits."""
    control = random_control(spark, 3, scenarios=2, names=["ramp_to_full", "ramp_to_low", "ramp_to_max"])
    plain = sorted(map(tuple, timeline_segments(control, control_bound(control)).collect()))
    big = Bound(rows=10_000, span_rows=16)
    assert sorted(map(tuple, timeline_segments(control, big, chain_block=4).collect())) == plain
    assert max(r[8] for r in plain) > 0


def test_scan_blocked_equals_plain(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "id * 7 % 1009 AS o", "IF(id % 4 = 0, NULL, id * 31 % 97) AS v")
    spec = {
        "running": {"mx": ("max", F.col("v")), "sm": ("sum", F.col("v")), "lt": ("last", F.col("v"))},
        "previous": {"pl": ("last", F.struct("v", "o"))},
        "following": {"nx": F.col("v"), "no": F.col("o")},
    }
    plain = Scan(["k"], "o").apply(df, **spec)
    blocked = Scan(["k"], "o", 10).apply(df, **spec).select(*plain.columns)
    assert sorted(plain.collect(), key=str) == sorted(blocked.collect(), key=str)


def test_cover_blocks_tile_the_range(spark):
    df = spark.range(60).crossJoin(spark.range(60).withColumnRenamed("id", "b")).filter("id < b")
    rows = df.select("id", "b", cover_blocks(F.col("id"), F.col("b")).alias("c")).collect()
    for r in rows:
        covered = sorted(x for c in r["c"] for x in range(c["block"] << c["level"], (c["block"] + 1) << c["level"]))
        assert covered == list(range(r["id"], r["b"]))
        assert len(r["c"]) <= 2 * max(1, (r["b"] - r["id"]).bit_length())


@pytest.mark.parametrize("bound,array_rows", [(None, 0), (None, 10_000), (Bound(rows=3_000, span_rows=64), 256)])
def test_states_match_brute_force(spark, bound, array_rows):
    control = random_control(spark, 11, scenarios=3)
    spikes = {}
    for r in expand_spikes(control.spikes, 5).collect():
        spikes.setdefault(r["scenario_id"], []).append(r.asDict())
    rows = {}
    for r in state_intervals(control, 5, bound=bound, array_rows=array_rows).collect():
        rows.setdefault(r["scenario_id"], []).append(r)
    assert len(rows) == 3
    for sid, intervals in rows.items():
        intervals.sort(key=lambda r: r["lo_ms"])
        # The intervals tile the clock without gap or overlap.
        assert intervals[0]["lo_ms"] == 0 and intervals[-1]["hi_ms"] == 1_000_000
        assert all(a["hi_ms"] == b["lo_ms"] for a, b in zip(intervals, intervals[1:], strict=False))
        for r in intervals:
            for t in (r["lo_ms"], r["hi_ms"] - 1):
                n, error, latency, unusual = brute.effect(spikes[sid], t)
                got = (r["n_active"], np.float32(r["spike_error"]), np.float32(r["latency_multiplier"]), r["unusual"])
                assert got == (n, error, latency, unusual)


def test_array_and_block_forms_describe_the_same_spikes(spark):
    control = random_control(spark, 21, scenarios=2, events=6, spikes=8)
    forms = [sorted(map(tuple, state_intervals(control, 3, describe=True, array_rows=n).collect()), key=str) for n in (0, 10_000)]
    assert forms[0] == forms[1] and any("," in r[-1] for r in forms[0])


def test_merged_rows_carry_one_state(spark):
    """No row of the merge holds more than its own state, and a hot scenario is cut by time."""
    cuts = range(0, 3_000_000, 100)
    intervals = spark.createDataFrame([("hot", i + 1, lo, lo + 100, 3_000_000, i) for i, lo in enumerate(cuts)], "scenario_id string, rank bigint, lo_ms bigint, hi_ms bigint, total_ms bigint, n_active bigint")
    kinds = {"unusual": "boolean", **{c: "bigint" for c in ("seg_lo", "start_lps", "end_lps", "start_bps", "end_bps", "ramp_ms")}}
    intervals = intervals.withColumns({c: F.lit(None).cast(kinds.get(c, "float")) for c in STATE_COLUMNS if c not in intervals.columns})
    rows = spark.range(20_000).selectExpr("id", "'hot' AS sid", "timestamp_millis(id * 157 - 90) AS ts")
    got = States(intervals, literal_rows=0, broadcast_rows=100).attach(rows, "ts", "1970-01-01 00:00:00", "sid")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Broadcast" not in plan and "Window" in plan
    times = [(i, i * 157 - 90) for i in range(20_000)]
    assert sorted((r.id, r.n_active) for r in got.select("id", "n_active").collect()) == [(i, t // 100) for i, t in times if 0 <= t < 3_000_000]


def test_three_lookup_forms_agree(spark):
    control = random_control(spark, 2, scenarios=1, events=4, spikes=6)
    intervals = state_intervals(control, 1)
    rows = spark.range(3000).selectExpr("id", "'s0' AS sid", "timestamp_millis(id * 400 - 5000) AS ts")
    origin = "1970-01-01 00:00:00"
    literal = attach_scenario(rows, States(intervals, literal_rows=500), "ts", origin)
    broadcast = attach_scenario(rows, States(intervals, literal_rows=0), "ts", origin, "sid")
    shuffled = attach_scenario(rows, States(intervals, literal_rows=0, broadcast_rows=2), "ts", origin, "sid")
    assert "Generate" not in literal._jdf.queryExecution().toString()
    want = sorted(map(str, literal.collect()))
    for other in (broadcast, shuffled):
        assert sorted(map(str, other.select(*literal.columns).collect())) == want
    assert len(want) == 2500


def test_repeats_and_jitter(spark):
    rows = [
        ("a", 0, 100, "error_burst", 10, None, None, None, None, None, None),
        ("a", 1, 100, "mixed", 10, 20.0, 80.0, 2.0, 5, 50, 3),
        ("a", 2, 100, "mixed", 10, None, None, None, 0, 50, 3),
        ("a", 3, 100, "mixed", 10, 30.0, 30.0, None, 2, 50, None),
    ]
    got = expand_spikes(table(spark, rows, SPIKES_SCHEMA), 9).collect()
    by = {}
    for r in got:
        by.setdefault(r["spike_idx"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {0: 1, 1: 5, 3: 2}
    assert by[0][0]["error"] == 0.5 and by[0][0]["latency"] == 1.0
    assert all(abs(r["start_ms"] - 100 - 50 * r["rep"]) <= 3 for r in by[1])
    assert all(0.2 <= r["error"] < 0.8 for r in by[1])
    assert sorted(r["start_ms"] for r in by[3]) == [100, 150]
    order = [(r["start_ms"], r["spike_idx"]) for r in trigger_order(expand_spikes(table(spark, rows, SPIKES_SCHEMA), 9)).collect()]
    assert order == sorted(order)


def test_repeat_numbers_in_chunks(spark):
    df = spark.createDataFrame(pa.table({"k": [1, 2, 3], "n": [0, 7, 23]}))
    got = repeat_numbers(df, F.col("n"), "i", chunk=5).groupBy("k").agg(F.sort_array(F.collect_list("i")).alias("i")).collect()
    assert {r["k"]: r["i"] for r in got} == {2: list(range(7)), 3: list(range(23))}
