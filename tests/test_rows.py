import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.functions.draws import slot_counts
from logloom.functions.vocab import METHODS, SERVER_ERROR_CODES, SUCCESS_CODES
from logloom.operators.attach import States, attach_scenario, inject_anomalies
from logloom.operators.audit import audit_distribution
from logloom.operators.formats import FORMAT_FIELDS, register_format, render
from logloom.operators.payloads import BODY_SHAPES, pack_keyed, pack_payloads
from logloom.plans import fixtures as X
from logloom.sources.rows import LOG_FIELDS, with_log_fields


def lines(spark, sf):
    return X.table(spark, sf, "lineitem").select(*X.LINE_KEYS, F.col("l_shipdate").alias("ts"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_timestamps(spark):
    ts = F.timestamp_millis(F.lit(1696945736123))
    r = spark.range(1).select(T.apache_ts(ts).alias("a"), T.iso_ts(ts).alias("i"), T.syslog_ts(ts).alias("s")).first()
    assert r["a"] == "[10/Oct/2023:13:48:56 +0000]"
    assert r["i"] == "2023-10-10T13:48:56.123Z"
    assert r["s"] == "2023-10-10T13:48:56.123000+00:00"


def test_leap_days(spark):
    days = {951782400: (2000, 2, 29), 1709164800: (2024, 2, 29), 1735603200: (2024, 12, 31), 4107456000: (2100, 2, 28)}
    df = spark.createDataFrame(pa.table({"s": list(days)}))
    for r in df.select("s", T.civil_date("s").alias("c")).collect():
        assert tuple(r["c"])[:3] == days[r["s"]]


def test_priorities(spark):
    df = spark.createDataFrame(pa.table({"l": ["DEBUG", "INFO", "WARN", "ERROR", "FATAL", "?"]}))
    assert [r[0] for r in df.select(T.priority("l")).collect()] == [135, 134, 132, 131, 130, 134]


def test_slots():
    counts = lambda runs: {v: sum(n for w, n in runs if w == v) for v, _ in runs}
    assert counts(slot_counts(SUCCESS_CODES)) == {200: 183, 201: 12, 204: 12, 206: 5, 301: 7, 302: 7, 304: 25, 307: 5}
    assert counts(slot_counts(SERVER_ERROR_CODES)) == {500: 129, 502: 51, 503: 51, 504: 25}
    assert counts(slot_counts(METHODS, total=100))["GET"] == 156


def test_fields_do_not_depend_on_partitioning(spark, sf):
    def digest(df):
        out = with_log_fields(df, X.LINE_KEYS, "ts", 3)
        return out.select(F.sum(F.xxhash64(*X.LINE_KEYS, *LOG_FIELDS) % 1_000_003)).first()[0]

    src = lines(spark, sf)
    want = digest(src)
    assert all(digest(src.repartition(n)) == want for n in (1, 4, 13))
    assert digest(src) != with_log_fields(src, X.LINE_KEYS, "ts", 4).select(F.sum(F.xxhash64(*X.LINE_KEYS, *LOG_FIELDS) % 1_000_003)).first()[0]


def test_pools_inline_and_broadcast_agree(spark, sf):
    a = with_log_fields(lines(spark, sf), X.LINE_KEYS, "ts", 3)
    b = with_log_fields(lines(spark, sf), X.LINE_KEYS, "ts", 3, pools="inline")
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty()


def test_hot_path_has_no_shuffle_and_no_python(spark, sf):
    states = States(X.month_states(spark).intervals)
    events = X.table(spark, sf, "events")
    rows = attach_scenario(events.select("event_id", "ts"), states, "ts", X.MONTH_ORIGIN)
    rows = with_log_fields(rows, ["event_id"], "ts", 1, error_rate=F.col("error_rate"), fields=FORMAT_FIELDS["apache"])
    text = plan(render(rows, "apache").select("line"))
    assert "Python" not in text and "Arrow" not in text
    # Broadcasts of the two fixed pools are the only exchanges.
    assert not re.search(r"(?<!Broadcast)Exchange", text.replace("BroadcastExchange", "Broadcast"))
    assert text.count("BroadcastExchange") == 2
    inline = with_log_fields(events.select("event_id", "ts"), ["event_id"], "ts", 1, pools="inline", fields=["status"])
    scan = plan(inline.select("status"))
    assert "Exchange" not in scan and "ReadSchema: struct<event_id:bigint>" in scan


def test_no_generated_method_is_too_long_to_compile(spark, sf, capsys):
    """The JVM leaves methods beyond 8000 bytes interpreted, at a tenth of the speed."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = {
            fmt: render(with_log_fields(lines(spark, sf), X.LINE_KEYS, "ts", 1, fields=fields), fmt).select("line")
            for fmt, fields in FORMAT_FIELDS.items()
        }
        month = attach_scenario(X.table(spark, sf, "events"), X.month_states(spark), "ts", X.MONTH_ORIGIN)
        customers = attach_scenario(
            X.customer_rows(spark, sf), X.customer_states(spark, sf), "l_shipdate", X.CUSTOMER_ORIGIN, "custkey"
        )
        plans |= {"month": month, "customers": customers, "inject": inject_anomalies(month.drop("rate_desc", "progress_pct", "lps"), ["event_id"])}
        for fmt, df in plans.items():
            df.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and all(n < 8000 for n in sizes), (fmt, sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize(
    ("fmt", "marks", "length"),
    [
        ("apache", ["HTTP/"], 100),
        ("nginx", ["HTTP/"], 100),
        ("json", ['"timestamp"', '"level"', '"service"', '"status"'], 200),
        ("syslog", ["[meta"], 100),
        ("event", ['"timestamp"', '"tags"', '"metrics"', '"request_count":1'], 150),
    ],
)
def test_line_shapes(spark, sf, fmt, marks, length):
    rows = render(with_log_fields(lines(spark, sf), X.LINE_KEYS, "ts", 1), fmt).limit(200).collect()
    for r in rows:
        assert all(m in r["line"] for m in marks) and len(r["line"]) > length - 30
        assert r["n_bytes"] == len(r["line"].encode()) + 1
    assert max(len(r["line"]) for r in rows) > length
    if fmt == "syslog":
        assert all(r["line"].startswith("<1") for r in rows)


def test_unknown_and_registered_formats(spark, sf):
    rows = with_log_fields(lines(spark, sf), X.LINE_KEYS, "ts", 1, fields=["status"])
    with pytest.raises(ValueError, match="unknown format"):
        render(rows, "xml")
    register_format("bare", lambda c: F.concat(F.lit("s="), c("status").cast("string")))
    assert render(rows, "bare").first()["line"].startswith("s=")
    from logloom.operators import formats

    formats._FORMATTERS.pop("bare")


def test_request_time_is_the_shortest_float_text(spark, sf):
    import numpy as np

    rows = with_log_fields(lines(spark, sf), X.LINE_KEYS, "ts", 1, fields=["request_time"])
    for r in rows.select("request_time", F.col("request_time").cast("string").alias("t")).collect():
        assert np.float32(r["t"]) == np.float32(r["request_time"])
        assert len(r["t"]) <= len(str(np.float32(r["request_time"])))


def greedy(texts, limit):
    out, size, current = [], 0, []
    for t in texts:
        current.append(t)
        size += len(t.encode()) + 1
        if size >= limit:
            out.append(current)
            size, current = 0, []
    return out + ([current] if current else [])


def body(lines_, shape):
    head, sep, tail = BODY_SHAPES[shape]
    return head + sep.join(lines_) + tail


def test_partition_packing_is_greedy_and_whole(spark):
    texts = [f"line {i} " + "é" * (i % 50) for i in range(5000)]
    df = spark.createDataFrame(pa.table({"line": texts})).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = pack_payloads(df, "apache", 2000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got.sort(key=lambda r: int(r["payload_id"].split("-")[2]))
    want = greedy(texts, 2000)
    assert [r["body"] for r in got] == [body(w, "raw") for w in want]
    assert [r["n_rows"] for r in got] == [len(w) for w in want]
    assert all(r["n_bytes"] == len(r["body"].encode()) for r in got)


def test_keyed_packing_with_a_hot_group_of_copies(spark):
    """A third of all rows are copies of one row; nothing is lost and batches keep their size."""
    rows = [(i, f"event number {i}") for i in range(400)] + [(7, "copied line " + "x" * 30)] * 200
    df = spark.createDataFrame(pa.table({"k": [r[0] for r in rows], "line": [r[1] for r in rows]}))
    packed = pack_payloads(df, "json", 500, ["k"], 3)
    got = [line for r in packed.collect() for line in r["body"][1:-1].split(",")]
    assert sorted(got) == sorted(r[1] for r in rows)
    assert all(r["n_bytes"] <= 500 + 45 for r in packed.collect())
    again = pack_payloads(df.repartition(5), "json", 500, ["k"], 3)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, again.collect()))
    assert pack_keyed(df.withColumn("fmt", F.lit("json")), ["k"], 1, 500).agg(F.sum("n_rows")).first()[0] == 600


def test_distribution_audit_stays_near_expectation(spark, sf):
    rows = with_log_fields(lines(spark, sf), X.LINE_KEYS, "ts", 5, fields=["method", "service", "referrer"])
    for field, df in (("method", 6), ("service", 7), ("referrer", 7)):
        chi2 = audit_distribution(rows, field).agg(F.sum("chi2_term")).first()[0]
        assert chi2 < 6 * df


def test_mixed_formats_do_not_run_interpreted(spark, sf):
    """A stage of five formats is beyond the 8,000 bytes the JVM compiles: it must run as split projections, unless the session says otherwise."""
    from logloom.plans.output_queries import mixed_lines

    name = "spark.sql.codegen.hugeMethodLimit"
    fresh = spark.newSession()
    fresh.conf.set("spark.sql.session.timeZone", "UTC")
    rows = mixed_lines(fresh, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "line")
    assert fresh.conf.get(name) == "8000"
    split = sorted(map(tuple, rows.limit(300).collect()))
    named = spark.newSession()
    named.conf.set("spark.sql.session.timeZone", "UTC")
    named.conf.set(name, "60000")
    rows = mixed_lines(named, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "line")
    assert named.conf.get(name) == "60000" and sorted(map(tuple, rows.limit(300).collect())) == split
