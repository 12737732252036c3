"""Plain-Python statements of the scenario rules, used to check the Spark operators on small inputs."""

from __future__ import annotations

import math

import numpy as np

PRESETS = {"trickle": 50_000, "low": 500_000, "medium": 2_500_000, "high": 3_750_000, "full": 5_000_000, "max": 10_000_000}


def value_at(state: dict, t: int) -> int:
    waited = t - state["lo"]
    if waited >= state["ramp"]:
        return state["end"]
    share = (waited // 1000 + waited % 1000 / 1000) / (state["ramp"] // 1000 + state["ramp"] % 1000 / 1000)
    step = math.trunc(abs(state["end"] - state["start"]) * share)
    return state["start"] + step if state["end"] >= state["start"] else state["start"] - step


def segments(events: list[dict], total: int) -> list[tuple]:
    """(lo, hi, start, end, ramp) by applying the events one after the other."""
    state = {"lo": 0, "start": PRESETS["low"], "end": PRESETS["low"], "ramp": 0}
    marks, now = {0: dict(state)}, 0
    for event in sorted(events, key=lambda e: e["idx"]):
        now = max(now, event["at_ms"])
        name = event["rate_name"]
        if name.startswith("ramp_to_"):
            in_force = state["start"] if state["ramp"] and now == state["lo"] else value_at(state, now)
            state = {"lo": now, "start": in_force, "end": PRESETS.get(name[8:], PRESETS["medium"]), "ramp": event["ramp_ms"] or 30_000}
        else:
            rate = PRESETS.get(name, PRESETS["medium"])
            state = {"lo": now, "start": rate, "end": rate, "ramp": 0}
        marks[now] = dict(state)
    times = sorted(t for t in marks if t < total)
    return [
        (t, times[i + 1] if i + 1 < len(times) else total, marks[t]["start"], marks[t]["end"], marks[t]["ramp"])
        for i, t in enumerate(times)
    ]


def effect(spikes: list[dict], t: int) -> tuple:
    """(n, error, latency, unusual) of the spikes active at t."""
    on = [s for s in spikes if s["start_ms"] <= t < s["end_ms"]]
    error = max([s["error"] for s in on if s["type"] in ("error_burst", "mixed")], default=0.0)
    latency = max([s["latency"] for s in on if s["type"] in ("latency_spike", "mixed")], default=0.0)
    return len(on), np.float32(error), np.float32(latency), any(s["type"] == "unusual_patterns" for s in on)
