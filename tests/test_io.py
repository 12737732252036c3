import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.operators import metrics, sinks
from logloom.operators.attach import States, attach_scenario
from logloom.operators.formats import FORMAT_FIELDS, render
from logloom.operators.payloads import pack_payloads
from logloom.operators.states import state_intervals
from logloom.operators.timeline import timeline_segments
from logloom.plans import fixtures as X
from logloom.sources.requests import expand_requests, validate_requests
from logloom.sources.rows import with_log_fields
from logloom.sources.scenarios import load_scenarios, override_scenario
from logloom.streaming import live

FULL = """
[scenario]
name = "demo"
total_duration = "5m"
[[timeline]]
at = "0s"
rate = "low"
error_rate = 1.5
[[timeline]]
at = "1m"
rate = "ramp_to_full"
duration = "30s"
[[timeline]]
at = "2m"
rate = { throughput_mb = 7, logs_per_sec = 1234 }
[[spikes]]
at = "90s"
type = "error_burst"
duration = "10s"
error_rate = { min = 20.0, max = 80.0 }
[spikes.repeat]
count = 3
interval = "20s"
jitter = "5s"
[[spikes]]
at = "3m"
type = "mixed"
duration = "8s"
error_rate = 60
latency_multiplier = 5.0
[rates]
low = { throughput_mb = 1, logs_per_sec = 10 }
"""


@pytest.fixture
def scenario_dir(tmp_path):
    (tmp_path / "full.toml").write_text(FULL)
    (tmp_path / "bare.toml").write_text('format = "tagged"\n[scenario]\nname = "bare"\ntotal_duration = "10s"\n')
    (tmp_path / "ms.toml").write_text('[scenario]\nname = "x"\ntotal_duration = "500ms"\n')
    (tmp_path / "kind.toml").write_text('[scenario]\nname = "x"\ntotal_duration = "5s"\n[[spikes]]\nat = "1s"\ntype = "flood"\nduration = "1s"\n')
    (tmp_path / "broken.toml").write_text("[scenario\n")
    return str(tmp_path)


def test_load_scenarios(spark, scenario_dir):
    control, rejected = load_scenarios(spark, f"{scenario_dir}/*.toml", aliases={"tagged": "event"})
    name = lambda df: {r["scenario_id"].split("/")[-1]: r for r in df.collect()}
    meta = name(control.meta)
    assert {k: (r["name"], r["total_ms"], r["format"]) for k, r in meta.items()} == {
        "full.toml": ("demo", 300_000, None),
        "bare.toml": ("bare", 10_000, "event"),
    }
    assert {k: r["error"].split(":")[0] for k, r in name(rejected).items()} == {
        "ms.toml": "bad total_duration", "kind.toml": "unknown spike type", "broken.toml": "not TOML",
    }
    events = [tuple(r)[1:] for r in control.timeline.orderBy("idx").collect()]
    assert events == [
        (0, 0, "low", None, None, None, 1.5),
        (1, 60_000, "ramp_to_full", None, None, 30_000, None),
        (2, 120_000, None, 1234, 7, None, None),
    ]
    spikes = [tuple(r)[1:] for r in control.spikes.orderBy("spike_idx").collect()]
    assert spikes == [
        (0, 90_000, "error_burst", 10_000, 20.0, 80.0, None, 3, 20_000, 5_000),
        (1, 180_000, "mixed", 8_000, 60.0, 60.0, 5.0, None, None, None),
    ]
    segments = timeline_segments(control).filter("scenario_id like '%full.toml'").orderBy("lo_ms").collect()
    # The redefined low preset is the initial state, the first event and the ramp's start.
    assert [(r["lo_ms"], r["start_lps"], r["end_lps"]) for r in segments] == [(0, 10, 10), (60_000, 10, 5_000_000), (120_000, 1234, 1234)]
    assert state_intervals(control, 1).filter("scenario_id like '%full.toml'").count() >= 9


def test_override(spark):
    control = override_scenario(X.month_control(spark), rate="3K", fmt="json")
    assert [tuple(r) for r in control.timeline.collect()] == [("month", 0, 0, None, 3000, 1, None, None)]
    assert control.meta.first()["format"] == "json" and control.spikes.count() == 6
    with pytest.raises(Exception, match="unknown rate"):
        override_scenario(X.month_control(spark), rate="fast").timeline.collect()


def test_requests_with_inline_documents(spark):
    good = {"output": "https://sink.invalid/i", "duration": "junk", "format": "json", "scenario_toml": FULL}
    texts = [json.dumps(good), json.dumps(good | {"scenario_toml": "[x"}), json.dumps({"output": "https://sink.invalid/i", "duration": "15m"})]
    df = spark.createDataFrame(pa.table({"id": [1, 2, 3], "json": texts}))
    got = expand_requests(df, "json", "id")
    meta = {r["scenario_id"]: (r["name"], r["total_ms"], r["format"]) for r in got["control"].meta.collect()}
    assert meta == {"1": ("demo", 300_000, "json"), "3": ("remote", 900_000, "event")}
    assert got["control"].spikes.count() == 2
    out = {r["scenario_id"]: r for r in got["outputs"].collect()}
    assert set(out) == {"1", "3"}
    assert (out["1"]["batch_format"], out["1"]["content_type"]) == ("array", "application/json")
    assert (out["3"]["batch_bytes"], out["3"]["timeout_s"], out["3"]["senders"], out["3"]["batch_format"]) == (1 << 20, 30, 8, "envelope")
    # Checking and expanding reject the same requests for the same reasons.
    rejected = {r["scenario_id"]: r["error"] for r in got["rejected"].collect()}
    assert rejected == {str(r["id"]): r["error"] for r in validate_requests(df, "json").filter("error is not null").collect()}
    assert list(rejected) == ["2"] and rejected["2"].startswith("invalid scenario document: not TOML")


def test_requests_with_wrong_types(spark):
    base = {"output": "https://sink.invalid/i", "duration": "15m"}
    bad = {
        "rate": [5, {"throughput_mb": 3}, {"throughput_mb": -1, "logs_per_sec": 2}, True], "http_batch_kb": [-1, "7", 1.5],
        "http_headers": [[{"name": "a"}], [{"name": "a", "value": 1}], {"a": "b"}], "duration": [90, None], "threads": ["2"], "http_senders": [-8],
    }
    cases = [base | {field: value} for field, values in bad.items() for value in values]
    fine = [base | {"rate": None, "threads": None}, base | {"rate": {"throughput_mb": 1, "logs_per_sec": 0}, "http_headers": [], "more": 1}]
    texts = [json.dumps(c) for c in [*cases, *fine]] + ["[]", "7", None]
    df = spark.createDataFrame(pa.table({"id": list(range(len(texts))), "json": texts}))
    errors = {r["id"]: r["error"] for r in validate_requests(df, "json").collect()}
    assert [i for i, e in errors.items() if e is None] == [len(cases), len(cases) + 1]
    assert all(e.startswith("invalid JSON") for e in errors.values() if e)
    got = expand_requests(df, "json", "id")
    assert {r["scenario_id"]: r["error"] for r in got["rejected"].collect()} == {str(i): e for i, e in errors.items() if e}
    assert {r["scenario_id"] for r in got["outputs"].collect()} == {str(i) for i, e in errors.items() if not e}


def test_files_and_discard(spark, sf, tmp_path):
    rows = with_log_fields(X.table(spark, sf, "events"), ["event_id"], "ts", 1, fields=FORMAT_FIELDS["apache"])
    out = render(rows, "apache")
    sinks.write_lines(out.withColumn("fmt", F.lit("apache")), str(tmp_path / "a"), compression="gzip", partition_by=("fmt",))
    back = spark.read.text(str(tmp_path / "a"))
    assert back.count() == out.count() and back.select("value").exceptAll(out.select("line")).isEmpty()
    sinks.write_lines(out.limit(3), str(tmp_path / "a"))
    assert spark.read.text(str(tmp_path / "a")).count() == 3
    sinks.discard(out)


def make_send(folder):
    def send(payload):
        import os
        import uuid

        kind = int(payload["payload_id"].split("-")[-1]) % 4
        tried = f"{folder}/{payload['payload_id']}"
        os.makedirs(tried, exist_ok=True)
        attempt = len(os.listdir(tried))
        open(f"{tried}/{uuid.uuid4()}", "w").close()
        if kind == 0:
            return 200
        if kind == 1:
            return 503 if attempt < 2 else 204
        if kind == 2:
            raise ConnectionError("refused")
        return 404

    return send


def test_delivery(spark, tmp_path):
    texts = [f"line number {i:05d}" for i in range(800)]
    payloads = pack_payloads(spark.createDataFrame(pa.table({"line": texts})).coalesce(1), "apache", 1800)
    n = payloads.count()
    sinks.deliver(payloads, make_send(str(tmp_path / "tries")), pause=lambda s: None).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    tries = {}
    for r in log.orderBy("attempt").collect():
        tries.setdefault(int(r["payload_id"].split("-")[-1]), []).append(r["http_status"])
    want = {0: [200], 1: [503, 503, 204], 2: [None] * 4, 3: [404]}
    assert len(tries) == n and all(v == want[k % 4] for k, v in tries.items())
    report = sinks.delivery_report(log).first()
    sizes = {int(r["payload_id"].split("-")[-1]): r["n_bytes"] for r in payloads.collect()}
    assert report["bytes_written"] == sum(v for k, v in sizes.items() if k % 4 < 2)
    assert report["requests_sent"] == sum(1 for v in tries.values() for s in v if s is not None)
    assert report["requests_failed"] == sum(1 for k in tries if k % 4 > 1)


def test_headers_and_backoff():
    import random

    assert sinks.request_headers("application/json", "Basic x", {"X-A": "1"}) == {
        "Content-Type": "application/json", "Authorization": "Basic x", "X-A": "1",
    }
    rng = random.Random(1)
    for attempt, base in ((1, 20), (3, 80), (6, 640), (9, 640)):
        assert base <= sinks.backoff_ms(attempt, rng) <= base * 1.5


def test_summary_of_no_rows(spark, sf):
    rows = render(with_log_fields(X.table(spark, sf, "events").limit(0), ["event_id"], "ts", 1), "json")
    r = metrics.summary(rows, "ts").first()
    assert (r["logs"], r["bytes"], r["errors"], r["error_pct"], r["target_met"]) == (0, 0, 0, 0.0, False)


EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def month_lines(spark, df):
    # A stream joins the same way; the state table of one scenario becomes literals.
    rows = attach_scenario(df, States(X.month_states(spark).intervals), "ts", X.MONTH_ORIGIN)
    return render(with_log_fields(rows, ["event_id"], "ts", 1, error_rate=F.col("error_rate"), fields=FORMAT_FIELDS["json"]), "json")


@pytest.fixture
def event_files(spark, sf, tmp_path):
    path = str(tmp_path / "events")
    X.table(spark, sf, "events").repartitionByRange(4, "ts").write.parquet(path)
    return path


def test_stream_enrichment_equals_batch(spark, event_files, tmp_path):
    stream = month_lines(spark, live.read_stream(spark, event_files, EVENT_SCHEMA, max_files=1))
    query = (
        stream.select("event_id", "line").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = month_lines(spark, spark.read.parquet(event_files)).select("event_id", "line")
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_stream_throughput_equals_closed_batch_intervals(spark, event_files, tmp_path):
    stream = month_lines(spark, live.read_stream(spark, event_files, EVENT_SCHEMA, max_files=4))
    query = live.start_throughput(stream, "ts", str(tmp_path / "out"), str(tmp_path / "cp"), every="6 hours", delay="1 hour")
    assert query.awaitTermination(240)
    got = {r["start"].timestamp(): (r["logs"], r["bytes"], r["errors"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = metrics.throughput(month_lines(spark, spark.read.parquet(event_files)), "ts", 6 * X.HOUR)
    want = {r["bucket"] * 6 * 3600.0: (r["logs"], r["bytes"], r["errors"]) for r in batch.collect()}
    assert len(got) >= len(want) - 2 and all(want[k] == v for k, v in got.items())


def test_stream_delivery(spark, event_files, tmp_path):
    stream = month_lines(spark, live.read_stream(spark, event_files, EVENT_SCHEMA, max_files=2)).withColumn("fmt", F.lit("json"))
    attempts = str(tmp_path / "attempts")
    query = live.deliver_stream(stream, lambda payload: 200, attempts, str(tmp_path / "cp"), limit_bytes=20_000)
    assert query.awaitTermination(240)
    log = spark.read.parquet(attempts)
    assert log.select("batch_id").distinct().count() == 2
    report = sinks.delivery_report(log).first()
    lines = month_lines(spark, spark.read.parquet(event_files)).agg(F.sum("n_bytes")).first()[0]
    # One bracket pair replaces the last line break of each payload.
    assert report["bytes_written"] == lines + log.count() and report["requests_failed"] == 0
