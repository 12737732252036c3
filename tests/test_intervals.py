"""Budgets, bucket labels and alert search against plain Python, in one block and in many."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators.audit import detection_delay, truth_buckets
from logloom.operators.budget import row_budget

SPIKE = "scenario_id string, spike_idx bigint, rep bigint, type string, start_ms bigint, end_ms bigint"


def spikes_of(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randrange(-50, 1000)
        out.append((f"s{i % 2}", i, 0, "mixed", start, start + rng.choice([0, 1, 7, 120, 400])))
    return [*out, ("s0", n, 0, "mixed", 100, 200), ("s0", n + 1, 0, "mixed", 200, 300)]


@pytest.mark.parametrize("span", [1 << 16, 2])
def test_truth_buckets(spark, span):
    rows, total, width = spikes_of(40), 1003, 10
    meta = spark.createDataFrame([("s0", total), ("s1", total), ("quiet", 25)], "scenario_id string, total_ms bigint")
    got = {(r.scenario_id, r.bucket): (r.started, r.spike_ms, r.anomalous_ms, r.is_anomaly) for r in truth_buckets(spark.createDataFrame(rows, SPIKE), meta, width, span).collect()}
    expected = {}
    for sid, end in (("s0", total), ("s1", total), ("quiet", 25)):
        own = [(max(a, 0), min(b, end)) for s, *_, a, b in rows if s == sid and max(a, 0) < min(b, end)]
        for k in range(-(-end // width)):
            lo, hi = k * width, min((k + 1) * width, end)
            each = sum(max(0, min(b, hi) - max(a, lo)) for a, b in own)
            some = sum(any(a <= t < b for a, b in own) for t in range(lo, hi))
            expected[sid, k] = (sum(lo <= a < hi for a, _ in own), each, some, 2 * some > hi - lo)
    assert got == expected


@pytest.mark.parametrize("longest", [None, 300_000])
@pytest.mark.parametrize("span", [1 << 16, 2])
def test_truth_buckets_of_long_clocks(spark, span, longest):
    """Pauses longer than a block of buckets; spikes without end, without length, beyond their clock or of no clock."""
    rows = [("a", 0, 0, "mixed", -5, 3), ("a", 1, 0, "mixed", 249_999, None), ("a", 2, 0, "mixed", 300_000, 300_010), ("a", 3, 0, "mixed", 7, 7)]
    rows += [("b", 0, 0, "mixed", 50, 10**9), ("none", 0, 0, "mixed", 1, 9), ("empty", 0, 0, "mixed", 0, 9), (None, 0, 0, "mixed", 0, 9)]
    clocks, width = [("a", 300_000), ("b", 201), ("empty", 0)], 2
    out = truth_buckets(spark.createDataFrame(rows, SPIKE), spark.createDataFrame(clocks, "scenario_id string, total_ms bigint"), width, span, longest_ms=longest)
    expected = set()
    for sid, total in clocks:
        own = [(max(a, 0), total if b is None else min(b, total)) for s, *_, a, b in rows if s == sid]
        own = [(a, b) for a, b in own if a < b]
        for k in range(-(-total // width)):
            lo, hi = k * width, min((k + 1) * width, total)
            ms = sum(max(0, min(b, hi) - max(a, lo)) for a, b in own)  # no two of them meet
            expected.add((sid, k, sum(lo <= a < hi for a, _ in own), ms, ms, 2 * ms > hi - lo))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(expected) == 150_101 and set(got) == expected


@pytest.mark.parametrize("span", [1 << 16, 3])
def test_next_alert_of_a_spike(spark, span):
    rows, width = spikes_of(60, seed=8), 10
    rng = random.Random(1)
    alerts = sorted({(f"s{rng.randrange(3)}", rng.randrange(-8, 130)) for _ in range(30)})
    out = detection_delay(spark.createDataFrame(alerts, "scenario_id string, bucket bigint"), spark.createDataFrame(rows, SPIKE), width, span)
    got = {r.spike_idx: (r.first_bucket, r.detected) for r in out.collect()}
    expected = {}
    for sid, idx, _, _, a, b in rows:
        if b > a:
            hit = min((k for s, k in alerts if s == sid and a // width <= k <= (b - 1) // width), default=None)
            expected[idx] = (hit, hit is not None)
    assert got == expected
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [1 << 16, 2])
def test_budget_loses_no_fraction(spark, block):
    """Sums over buckets are the floored totals, for rows and for bytes; ramps and pauses by small steps."""
    segments = [("a", 0, 1500, 7, 7, 333, 333, 0), ("a", 1500, 2600, 7, 31, 333, 5001, 1000), ("a", 2600, 3700, 0, 0, 1, 1, 0), ("a", 3700, 9999, 3, 3, 77, 77, 0), ("b", 0, 10, 1, 1, 5, 5, 0)]
    names = "scenario_id string, lo_ms bigint, hi_ms bigint, start_lps bigint, end_lps bigint, start_bps bigint, end_bps bigint, ramp_ms bigint"
    got = row_budget(spark.createDataFrame(segments, names), 700, block=block).collect()
    cells = {(r.scenario_id, r.bucket): (r.n_rows, r.n_bytes) for r in got}
    assert sorted(cells) == [("a", k) for k in range(15)] + [("b", 0)]

    def target(sid, t, what):
        total = 0
        for s, lo, hi, x, y, bx, by, ramp in segments:
            if s == sid and lo < t:
                dt, (u, v) = min(t, hi) - lo, (x, y) if what == 0 else (bx, by)
                inside = min(dt, ramp)
                total += u * inside + ((v - u) * inside * inside // (2 * ramp) if ramp else 0) + v * (dt - inside)
        return total // 1000

    for (sid, k), found in cells.items():
        end = 9999 if sid == "a" else 10
        for what in (0, 1):
            assert found[what] == target(sid, min((k + 1) * 700, end), what) - target(sid, k * 700, what)
    thin = row_budget(spark.createDataFrame(segments, names), 700, thin=3).agg(F.sum("n_bytes")).first()[0]
    assert thin == sum(sum(target(s, e, 1) for _ in (0,)) // 3 for s, e in (("a", 9999), ("b", 10)))
