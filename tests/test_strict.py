"""What must not pass silently: odd clocks, rows that cannot be packed, broken lines and documents."""

import tomllib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.functions.draws import weighted_slots
from logloom.operators import audit, payloads
from logloom.operators.attach import STATE_COLUMNS, States, elapsed_ms
from logloom.operators.parse import ingest_report, parse_lines
from logloom.sources.rows import generate_rows
from logloom.sources.scenarios import _SHAPE, shape_error

TYPES = {"seg_lo": "bigint", "lo_ms": "bigint", "hi_ms": "bigint", "total_ms": "bigint", "unusual": "boolean", "n_active": "bigint"}
YEAR, DAY = 365 * 86_400_000, 86_400_000


def intervals_of(spark, scenarios):
    """Interval tables from the cuts of each scenario; n_active tells intervals apart."""
    rows = [(s, i + 1, lo, hi, cuts[-1], i) for s, cuts in scenarios.items() for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    df = spark.createDataFrame(rows, "scenario_id string, rank bigint, lo_ms bigint, hi_ms bigint, total_ms bigint, n_active bigint")
    rest = {c: F.lit(None).cast(TYPES.get(c, "double")) for c in STATE_COLUMNS if c not in df.columns}
    return df.withColumns(rest).cache()


@pytest.mark.parametrize("broadcast_rows", [200_000, 300])
def test_each_row_meets_one_interval(spark, broadcast_rows):
    rng = np.random.default_rng(2)
    crowded = [0, *sorted(set((100 * DAY + rng.integers(0, DAY, 10_000)).tolist())), YEAR]
    scenarios = {"crowded": crowded, "plain": [0, 10, 20, 1000], "one": [5, 50]}
    times = [(s, int(t)) for s, cuts in scenarios.items() for t in [*rng.integers(-5, cuts[-1] + 5, 200), *rng.choice(cuts, 100), 100 * DAY + 7]]
    rows = spark.createDataFrame(times, "sid string, ms bigint").withColumn("ts", F.timestamp_millis("ms"))
    states = States(intervals_of(spark, scenarios), broadcast_rows=broadcast_rows)
    got = states.attach(rows, "ts", "1970-01-01 00:00:00", "sid")
    expected = [(s, t, int(np.searchsorted(scenarios[s], t, "right")) - 1) for s, t in times if scenarios[s][0] <= t < scenarios[s][-1]]
    assert sorted((r.sid, r.ms, r.n_active) for r in got.select("sid", "ms", "n_active").collect()) == sorted(expected)


def test_many_intervals_of_one_scenario_need_no_column(spark):
    cuts = list(range(0, 6700, 100))
    rows = spark.createDataFrame([(t,) for t in range(0, 6600, 37)], "ms bigint").withColumn("ts", F.timestamp_millis("ms"))
    got = States(intervals_of(spark, {"only": cuts})).attach(rows, "ts", "1970-01-01 00:00:00").select("ms", "n_active").collect()
    assert sorted((r.ms, r.n_active) for r in got) == [(t, t // 100) for t in range(0, 6600, 37)]
    two = States(intervals_of(spark, {"a": cuts, "b": cuts}))
    with pytest.raises(ValueError, match="several scenarios"):
        two.attach(rows, "ts", "1970-01-01 00:00:00")


def test_packers_refuse_rows_they_would_lose(spark):
    df = spark.createDataFrame([("json", "{}", 1), ("json", None, 2), (None, "x", 3)], "fmt string, line string, k int")
    good, bad = payloads.packable(df)
    assert [r.k for r in good.collect()] == [1] and sorted(r.k for r in bad.collect()) == [2, 3]
    for keys in ((), ("k",)):
        assert payloads.pack_payloads(good, None, order_cols=keys, buckets=1).first().n_rows == 1
        with pytest.raises(Exception, match="cannot be packed"):
            payloads.pack_payloads(df, None, order_cols=keys, buckets=1).collect()


def test_left_over_slots_go_to_the_first_value(spark):
    of = lambda rows: sorted((r.value, r.slot_lo, r.slot_hi) for r in weighted_slots(spark.createDataFrame(rows, "v string, w bigint, o int"), "v", "w", 256, "o").collect())
    assert of([("a", 1, 0), ("b", 999, 1), ("c", 5000, 2)]) == [("a", 255, 256), ("b", 0, 42), ("c", 42, 255)]
    assert of([(f"v{i:03}", 1, i) for i in range(300)]) == [("v000", 0, 256)]
    assert of([]) == []


COMBINED = '1.2.3.4 - bob [01/Jan/2024:00:00:00 +0000] "GET /a HTTP/1.1" 200 5 "-" "agent"'
LINES = {
    "apache": (COMBINED, [COMBINED.replace("01/Jan/2024:00:00:00 +0000", "not a time"), COMBINED.replace(" 5 ", " 99999999999999999999 "), "", None]),
    "nginx": (COMBINED + " 0.5", [COMBINED, COMBINED + " ..", COMBINED.replace("01/Jan", "41/Jan") + " 0.5"]),
    "syslog": (
        '<14>1 2024-01-01T00:00:00.000000+00:00 h s 7 M1 [meta request_id="r" duration_ms="3" level="INFO"] text',
        ['<14>1 yesterday h s 7 M1 [meta request_id="r" duration_ms="3" level="INFO"] text'],
    ),
    "json": (
        '{"timestamp":"2024-01-01T00:00:00.000Z","level":"INFO","status":200}',
        ['{"timestamp":"garbage","level":"INFO","status":200}', '{"timestamp":"2024-01-01T00:00:00.000Z"}', "[1", None],
    ),
    "event": (
        '{"timestamp":5,"tags":{"a":"b"},"metrics":{"m":1}}',
        ['{"timestamp":5}', '{"timestamp":5,"tags":{},"metrics":{"m":1}}', '{"timestamp":5,"tags":{"a":"b"}}', "x"],
    ),
}


@pytest.mark.parametrize("fmt", list(LINES))
def test_broken_lines_are_rejected_and_kept(spark, fmt):
    good, broken = LINES[fmt]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([good, *broken])], "k int, text string").withColumn("line", F.lit("another column"))
    got = {r.k: r for r in parse_lines(df, fmt, "text").collect()}
    assert [got[i].rejected for i in sorted(got)] == [False] + [True] * len(broken)
    for i in range(1, len(got)):
        assert set(got[i].asDict().values()) <= {i, "another column", None, True}


def test_empty_envelope_rejects_nothing(spark):
    bodies = {1: '{"events":[]}', 2: "x", 3: '{"events":[{"timestamp":1,"tags":{"a":"b"},"metrics":{"m":1}},{"timestamp":1}]}', 4: None}
    df = spark.createDataFrame(list(bodies.items()), "payload_id int, body string")
    assert {r.payload_id: (r.accepted, r.rejected) for r in ingest_report(df).collect()} == {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (0, 1)}


def test_audit_shows_values_that_never_occur(spark):
    got = {r.value: r for r in audit.audit_distribution(spark.range(100).select(F.lit("GET").alias("method")), "method").collect()}
    assert set(got) == {v for v, _ in audit.expected_shares("method")}
    assert got["GET"].observed == 100 and all(r.observed == 0 and r.chi2_term > 0 for v, r in got.items() if v != "GET")


HEAD = '[scenario]\nname = "n"\ntotal_duration = "1m"\n'


@pytest.mark.parametrize(
    "text",
    [
        '[[timeline]]\nat = "0s"\nrate = 5',
        '[[timeline]]\nat = "0s"\nrate = {throughput_mb = 7}',
        '[[timeline]]\nat = "0s"\nrate = "low"\nerror_rate = "abc"',
        '[[spikes]]\nat = "1s"\ntype = "mixed"\nduration = "2s"\nerror_rate = "abc"',
        '[[spikes]]\nat = "1s"\ntype = "mixed"\nduration = "2s"\nerror_rate = {min = 20.0}',
        '[[spikes]]\nat = "1s"\ntype = "mixed"\nduration = "2s"\nlatency_multiplier = "x"',
        '[rates]\nlow = {logs_per_sec = 5}',
        "format = 3",
    ],
)
def test_mistyped_documents_are_refused(text):
    doc = tomllib.loads(HEAD)
    assert shape_error(doc, _SHAPE) is None
    assert shape_error(doc | tomllib.loads(text), _SHAPE).startswith("wrong type")


def test_other_session_zones_are_refused(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="UTC"):
            elapsed_ms("ts", "2024-01-01 00:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_row_offsets_are_exact_in_large_buckets(spark):
    n = 13_000_000_000_000
    budget = spark.createDataFrame([("s", 0, 3)], "scenario_id string, bucket bigint, n_rows bigint")
    assert sorted(r.t_ms for r in generate_rows(budget, DAY, "1970-01-01").collect()) == [0, DAY // 3, 2 * DAY // 3]
    exact = F.expr(f"cast(cast({n - 1} as bigint) as decimal(20,0)) * cast({DAY} as decimal(18,0)) div cast({n} as bigint)")
    assert spark.range(1).select(exact).first()[0] == (n - 1) * DAY // n
