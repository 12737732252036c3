"""Whole runs: planned rows, rendered lines, payload borders, refused formats, dense intervals."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import metrics, run
from logloom.operators.attach import States
from logloom.operators.budget import row_budget
from logloom.operators.payloads import BODY_SHAPES
from logloom.operators.timeline import timeline_segments
from logloom.plans import fixtures as X
from logloom.plans import run_queries as Q
from logloom.sources.requests import expand_requests

ORIGIN = X.CUSTOMER_ORIGIN


@pytest.fixture(scope="module")
def lines(spark, sf):
    rows = Q.run_lines(spark, sf).select(*run.RUN_KEYS, "fmt", "line", "n_bytes", "ts", "is_error")
    return rows.persist()


def test_rows_are_the_planned_ones(spark, sf, lines):
    plan = row_budget(timeline_segments(X.short_control(spark, sf)), Q.BUCKET).select("scenario_id", "bucket", "n_rows").filter("n_rows > 0")
    made = lines.groupBy("scenario_id", "bucket").agg(F.count("*").alias("n_rows"))
    assert sorted(plan.collect()) == sorted(made.collect())
    assert {r["fmt"] for r in lines.select("fmt").distinct().collect()} == {"apache", "json", "syslog", "event", "nginx"}


def test_text_is_shuffled_once(spark):
    rows = spark.range(9).select(F.lit("s").alias("scenario_id"), F.lit(0).alias("bucket"), F.col("id").alias("i"), F.lit("json").alias("fmt"), F.lit("{}").alias("line"))
    plan = run.run_payloads(rows, 4096, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_payloads_hold_every_line_and_keep_the_grid(lines):
    window, limit = 7, 2048
    got = run.run_payloads(lines, limit, window, block=2).collect()
    groups: dict[tuple, list] = {}
    for r in sorted(lines.collect(), key=lambda r: (r["scenario_id"], r["bucket"], r["i"])):
        groups.setdefault((r["scenario_id"], r["bucket"] // window, r["i"] // 2), []).append(r)
    expected = {}
    for key, rows in groups.items():
        at, batches = 0, {}
        for r in rows:
            batches.setdefault(at // limit, []).append(r["line"])
            at += len(r["line"].encode()) + 1
        head, sep, tail = BODY_SHAPES[{"event": "envelope", "json": "array"}.get(rows[0]["fmt"], "raw")]
        for b, texts in batches.items():
            expected["-".join(map(str, (*key, b)))] = head + sep.join(texts) + tail
    assert {r["payload_id"]: r["body"] for r in got} == expected
    assert all(r["n_bytes"] == len(r["body"].encode()) for r in got)


def test_unknown_format_is_refused_before_the_run(spark, sf):
    control = X.short_control(spark, sf)
    odd = control.with_(meta=control.meta.withColumn("format", F.lit("xml")))
    with pytest.raises(ValueError, match="unknown format 'xml'"):
        run.run_rows(odd, ORIGIN)
    with pytest.raises(ValueError, match="unknown format"):
        run.run_rows(control.with_(meta=control.meta.withColumn("format", F.lit("json"))), ORIGIN, formats=["apache"])


def test_requests(spark):
    doc = '[scenario]\nname = "s"\ntotal_duration = "4s"\n[[timeline]]\nat = "0s"\nrate = {throughput_mb = 1, logs_per_sec = 5}\n[[spikes]]\nat = "2s"\ntype = "error_burst"\nduration = "2s"\nerror_rate = 100.0\n'
    texts = [
        ("a", {"output": "http://one.invalid/", "duration": "3s", "rate": {"throughput_mb": 1, "logs_per_sec": 4}, "format": "nginx", "http_batch_kb": 1}),
        ("b", {"output": "https://two.invalid/", "duration": "1s", "scenario_toml": doc, "format": "json"}),
        ("c", {"output": "ftp://three.invalid/", "duration": "1s"}),
    ]
    df = spark.createDataFrame([(k, json.dumps(t)) for k, t in texts], "id string, json string")
    out = run.run_requests(df, "json", "id", ORIGIN, window_buckets=100)
    rows = out["rows"].select("scenario_id", "t_ms", "status", "fmt").collect()
    assert sorted((r["scenario_id"], r["fmt"]) for r in rows) == [("a", "nginx")] * 12 + [("b", "json")] * 20
    assert all((r["status"] >= 400) for r in rows if r["scenario_id"] == "b" and r["t_ms"] >= 2000)
    packed = out["payloads"].collect()
    assert {(r["scenario_id"], r["url"]) for r in packed} == {("a", "http://one.invalid/"), ("b", "https://two.invalid/")}
    assert sum(r["n_rows"] for r in packed) == 32
    # One KiB a batch: several for the twelve lines of the first, one for the second.
    assert sum(r["scenario_id"] == "a" for r in packed) > 1 and sum(r["scenario_id"] == "b" for r in packed) == 1
    assert len(json.loads(next(r["body"] for r in packed if r["scenario_id"] == "b"))) == 20
    assert [r["scenario_id"] for r in out["rejected"].collect()] == ["c"]


def test_no_scripts_no_rows(spark, sf):
    control = Q.run_control(spark, sf)
    empty = control.with_(**{n: getattr(control, n).limit(0) for n in ("meta", "timeline", "spikes", "rates")})
    rows = run.run_rows(empty, ORIGIN)
    assert rows.count() == 0 and run.run_payloads(rows).count() == 0 and run.run_totals(rows).count() == 0


def test_dense_intervals(spark):
    rows = spark.createDataFrame([("a", 3, 10), ("a", 9, 5), ("b", 4, 1), ("b", 100_000, 2)], "k string, bucket bigint, bytes bigint")
    rows = rows.withColumns({"logs": F.lit(1).cast("bigint"), "errors": F.lit(0).cast("bigint")})
    out = metrics.running_totals(metrics.without_holes(rows, ["k"], block=1000), ["k"], block=1000)
    a = out.filter("k = 'a'").orderBy("bucket").select("bucket", "logs", "bytes", "total_bytes").collect()
    assert [tuple(r) for r in a] == [(3, 1, 10, 10), (4, 0, 0, 10), (5, 0, 0, 10), (6, 0, 0, 10), (7, 0, 0, 10), (8, 0, 0, 10), (9, 1, 5, 15)]
    b = out.filter("k = 'b'").agg(F.count("*"), F.countDistinct("bucket"), F.sum("logs"), F.max("total_bytes"), F.min("bucket"), F.max("bucket")).first()
    assert tuple(b) == (99_997, 99_997, 2, 3, 4, 100_000)
    assert metrics.without_holes(rows.limit(0), ["k"]).count() == 0


def _requests(spark, *asked):
    """Requests of ``(id, seconds, logs a second, format, target)``."""
    text = lambda s, n, fmt, url: json.dumps({"output": f"https://{url}.invalid/", "duration": f"{s}s", "rate": {"throughput_mb": 1, "logs_per_sec": n}, "format": fmt, "http_batch_kb": 1})
    return spark.createDataFrame([(k, text(*rest)) for k, *rest in asked], "id string, json string")


def _packed_after_a_shuffle(requests, window):
    got = expand_requests(requests, "json", "id")
    rows = run.run_rows(got["control"], ORIGIN, outputs=got["outputs"])
    return run.run_payloads(rows, F.col("batch_bytes"), window).join(got["outputs"].select("scenario_id", "url"), "scenario_id")


def test_requests_make_their_text_where_it_is_packed(spark):
    out = run.run_requests(_requests(spark, ("a", 3, 4, "json", "one"), ("b", 1, 2, "syslog", "two")), "json", "id", ORIGIN, window_buckets=60)
    plan = out["payloads"]._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "Window" in above and "ObjectHashAggregate" in above and "Exchange" not in above


@pytest.mark.parametrize("most", [1 << 18, 20, 0])
def test_large_groups_of_requests_pack_alike(spark, monkeypatch, most):
    monkeypatch.setattr(run, "GROUP_ROWS", most)
    monkeypatch.setattr(run, "TASK_ROWS", 16)
    df = _requests(spark, ("a", 5, 9, "json", "one"), ("b", 2, 3, "syslog", "two"), ("c", 4, 2, "nginx", "two"), ("d", 3, 40, "event", "one"))
    made = run.run_requests(df, "json", "id", ORIGIN, window_buckets=2)
    columns = made["payloads"].columns
    got, old = (sorted(map(tuple, x.select(columns).collect())) for x in (made["payloads"], _packed_after_a_shuffle(df, 2)))
    assert got == old and sum(r["n_rows"] for r in made["payloads"].collect()) == 45 + 6 + 8 + 120
    assert made["rows"].count() == 179 and "_deal" not in made["rows"].columns and "url" not in made["rows"].columns


def test_every_target_of_a_repeated_id_gets_all_payloads(spark, monkeypatch):
    class Carried(States):
        def __init__(self, intervals):
            super().__init__(intervals, broadcast_rows=0)

    monkeypatch.setattr(run, "States", Carried)
    df = _requests(spark, ("a", 2, 4, "json", "one"), ("a", 2, 4, "json", "two"), ("b", 1, 3, "apache", "one"), (None, 2, 2, "json", "one"))
    out = run.run_requests(df, "json", "id", ORIGIN, window_buckets=60)["payloads"]
    got, old = (sorted(map(tuple, x.select(out.columns).collect())) for x in (out, _packed_after_a_shuffle(df, 60)))
    assert got == old and {r["url"] for r in out.filter("scenario_id = 'a'").collect()} == {"https://one.invalid/", "https://two.invalid/"}
    assert {r["scenario_id"] for r in out.collect()} == {"a", "b"}
