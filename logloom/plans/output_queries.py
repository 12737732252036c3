"""Queries over formatters, payloads, metrics, parsers and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, metrics, payloads, sinks
from ..operators.attach import attach_scenario
from ..operators.formats import FORMAT_FIELDS, render
from ..operators.parse import explode_events, ingest_report, parse_lines
from ..sources.rows import with_log_fields
from . import fixtures as Z
from . import oracle_parts as O
from .registry import query

KEYS = O.LINE_KEYS


def line_rows(spark: SparkSession, d: str, *formats: str, digest: str = Z.DIGEST) -> DataFrame:
    """Line items with the fields the formats need (all of them without a format)."""
    rows = Z.table(spark, d, "lineitem").select(*Z.LINE_KEYS, F.col("l_shipdate").alias("ts"))
    return with_log_fields(rows, Z.LINE_KEYS, "ts", Z.SEED, digest, fields=_fields_of(formats))


def event_rows(spark: SparkSession, d: str, *formats: str) -> DataFrame:
    rows = Z.table(spark, d, "events").select("event_id", "ts")
    return with_log_fields(rows, Z.EVENT_KEYS, "ts", Z.SEED, Z.DIGEST, fields=_fields_of(formats))


def _fields_of(formats: tuple[str, ...]) -> list[str] | None:
    return list(dict.fromkeys(f for name in formats for f in FORMAT_FIELDS[name])) or None


def month_fields(spark: SparkSession, d: str, fields: list[str]) -> DataFrame:
    """Events with scenario state and fields drawn at the scenario's error rate."""
    rows = Z.table(spark, d, "events").select("event_id", "ts", "event_type")
    rows = attach_scenario(rows, Z.month_states(spark, True), "ts", Z.MONTH_ORIGIN)
    return with_log_fields(rows, Z.EVENT_KEYS, "ts", Z.SEED, Z.DIGEST, error_rate=F.col("error_rate"), fields=fields)


def _month_fields_sql(select: str) -> str:
    attached = O.state_ctes(O.MONTH_CONTROL, O.MONTH_ROWS, O.EVENT_KEYS)
    for old, new in (("a0 AS", "at0 AS"), ("FROM a0", "FROM at0"), ("a0.*", "at0.*")):
        attached = attached.replace(old, new)
    source = "SELECT event_id, ts, event_type, seg_lo, active_spikes, spike_active, error_fp FROM a"
    return f"WITH RECURSIVE {attached}, {O.field_ctes(source, O.EVENT_KEYS, rate='(error_fp::FLOAT / 10000::FLOAT)')} {select}"


@query(
    "flagship_error_mix",
    _month_fields_sql("SELECT event_type, spike_active, count(*) AS n_rows, count(*) FILTER (status >= 400) AS n_errors FROM f GROUP BY ALL"),
)
def flagship(spark, d):
    rows = month_fields(spark, d, ["status"])
    return rows.groupBy("event_type", "spike_active").agg(
        F.count("*").alias("n_rows"), F.sum((F.col("status") >= 400).cast("bigint")).alias("n_errors")
    )


# -- F1-F6 ----------------------------------------------------------------------------------------
_LINES = {"f1_apache": ("apache", O.COMBINED), "f3_json": ("json", O.JSON_LINE), "f4_syslog": ("syslog", O.SYSLOG_LINE), "f5_event": ("event", O.EVENT_LINE)}


def _register_formats() -> None:
    for name, (fmt, sql) in _LINES.items():
        query(name, O.fields(f"SELECT {KEYS}, {sql} AS line, strlen({sql}) + 1 AS n_bytes FROM f"))(
            lambda spark, d, fmt=fmt: render(line_rows(spark, d, fmt), fmt).select(*Z.LINE_KEYS, "line", "n_bytes")
        )


_register_formats()


@query("f2_nginx", O.fields(f"SELECT {KEYS}, {O.COMBINED} AS head, round(request_time::DOUBLE * 1000000)::BIGINT AS request_us FROM f"))
def f2(spark, d):
    # Float text is compared as whole microseconds: engines may print a FLOAT differently.
    rows = render(line_rows(spark, d, "nginx"), "nginx").select(*Z.LINE_KEYS, "line")
    seconds = F.substring_index("line", " ", -1)
    return rows.select(
        *Z.LINE_KEYS,
        F.expr("substring(line, 1, length(line) - length(substring_index(line, ' ', -1)) - 1)").alias("head"),
        F.round(seconds.cast("float").cast("double") * 1000000).cast("bigint").alias("request_us"),
    )


MIXED = ("apache", "json", "syslog", "event", "nginx")
_DISPATCH = f"[{', '.join(O.q(f) for f in MIXED)}][((l_linenumber + l_orderkey) % 5) + 1]"
_DISPATCH_LINE = (
    f"CASE (l_linenumber + l_orderkey) % 5 WHEN 0 THEN {O.COMBINED} WHEN 1 THEN {O.JSON_LINE} WHEN 2 THEN {O.SYSLOG_LINE} WHEN 3 THEN {O.EVENT_LINE} ELSE {O.NGINX_LINE} END"
)


def mixed_format(number: Column) -> Column:
    return F.get(F.array(*[F.lit(f) for f in MIXED]), (number % len(MIXED)).cast("int"))


def mixed_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = Z.table(spark, d, "lineitem").select(*Z.LINE_KEYS, F.col("l_shipdate").alias("ts"), mixed_format(F.col("l_linenumber") + F.col("l_orderkey")).alias("fmt"))
    fields = _fields_of(MIXED)
    drawn = with_log_fields(rows, Z.LINE_KEYS, "ts", Z.SEED, Z.DIGEST, fields=fields, fmt=F.col("fmt"), formats=MIXED)
    return render(drawn, F.col("fmt"), formats=MIXED).drop(*fields)


@query("f6_dispatch", O.fields(f"SELECT {KEYS}, {_DISPATCH} AS fmt, {_DISPATCH_LINE} AS line FROM f"))
def f6(spark, d):
    return mixed_lines(spark, d).select(*Z.LINE_KEYS, "fmt", "line")


# -- K4-K7, K10 -----------------------------------------------------------------------------------
LIMIT = 16_384


def _pack_sql(rows: str, keys: str, body: str) -> str:
    return f""", src2 AS ({rows}), nb AS (SELECT count(*) // 5000 + 1 AS nb FROM src2),
    b AS (SELECT src2.*, strlen(line) + 1 AS size, ('0x' || substr(md5(concat_ws('|', fmt, {keys}, line)), 1, 8))::BIGINT % nb AS bucket FROM src2, nb),
    c AS (SELECT *, (sum(size) OVER (PARTITION BY fmt, bucket ORDER BY {keys}, line ROWS UNBOUNDED PRECEDING) - size) // {LIMIT} AS batch FROM b),
    p AS (SELECT fmt || '-' || bucket || '-' || batch AS payload_id, fmt, count(*) AS n_rows, {body} AS body FROM c GROUP BY fmt, bucket, batch)"""


def packed(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    rows = render(event_rows(spark, d, fmt), fmt).select("event_id", "line")
    buckets = Z.table(spark, d, "events").count() // 5000 + 1
    return payloads.pack_payloads(rows, fmt, LIMIT, Z.EVENT_KEYS, buckets)


_JOIN = "string_agg(line, '{sep}' ORDER BY event_id, line)"
_BODIES = {
    "k4_raw_payload": ("apache", O.COMBINED, "string_agg(line, chr(10) ORDER BY event_id, line) || chr(10)"),
    "k5_array_payload": ("json", O.JSON_LINE, "'[' || string_agg(line, ',' ORDER BY event_id, line) || ']'"),
    "k6_envelope_payload": ("event", O.EVENT_LINE, "'{\"events\":[' || string_agg(line, ',' ORDER BY event_id, line) || ']}'"),
}


def _register_payloads() -> None:
    for name, (fmt, line, body) in _BODIES.items():
        pack = _pack_sql(f"SELECT event_id, '{fmt}' AS fmt, {line} AS line FROM f", "event_id", body)
        sql = O.event_fields("@").replace("@", f"{pack} SELECT payload_id, fmt, n_rows, strlen(body) AS n_bytes, body FROM p")
        query(name, sql)(lambda spark, d, fmt=fmt: packed(spark, d, fmt))


_register_payloads()


@query(
    "k7_size_batches",
    O.fields("@").replace(
        "@",
        _pack_sql(f"SELECT {KEYS}, {_DISPATCH} AS fmt, {_DISPATCH_LINE} AS line FROM f", KEYS, "sum(size)")
        + " SELECT payload_id, fmt, n_rows FROM p",
    ),
)
def k7(spark, d):
    rows = mixed_lines(spark, d).select(*Z.LINE_KEYS, "fmt", "line")
    buckets = Z.table(spark, d, "lineitem").count() // 5000 + 1
    return payloads.pack_payloads(rows, None, LIMIT, Z.LINE_KEYS, buckets).select("payload_id", "fmt", "n_rows")


@query(
    "k7_partition_batches",
    O.fields(f"SELECT {_DISPATCH} AS fmt, count(*) AS n_rows, sum(strlen({_DISPATCH_LINE})) AS line_bytes, 0 AS n_early, 0 AS n_late FROM f GROUP BY ALL"),
)
def k7_partition(spark, d):
    """The shuffle-free form: payload borders follow the partitions, so the rows are totals and broken closing rules.

    A payload is early if it stops below the limit though its partition has another one after it,
    and late if it would have reached the limit without its last line.
    """
    rows = mixed_lines(spark, d).select("fmt", "line")
    out = payloads.pack_payloads(rows, None, LIMIT)
    shape = payloads.batch_format(F.col("fmt"))
    frame = F.when(shape == "envelope", 13).when(shape == "array", 2).otherwise(1) + F.col("n_rows") - 1
    task, number = F.split("payload_id", "-")[1], F.split("payload_id", "-")[2].cast("int")
    out = out.select("fmt", "n_rows", (F.col("n_bytes") - frame).alias("bytes"), task.alias("task"), number.alias("number"))
    # Every line counts one byte more while a payload is filled.
    filled = F.col("bytes") + F.col("n_rows")
    longest = F.lit(2000)
    # The last payload of a partition may be short: one pass, as a join with the last numbers would pack everything twice.
    parts = out.groupBy("fmt", "task").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("line_bytes"), F.count_if(filled < LIMIT).alias("n_short"),
        F.max_by((filled < LIMIT).cast("int"), "number").alias("last_short"), F.count_if(filled - longest >= LIMIT).alias("n_late"),
    )
    return parts.groupBy("fmt").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("line_bytes").alias("line_bytes"), F.sum(F.col("n_short") - F.col("last_short")).alias("n_early"),
        F.sum("n_late").alias("n_late"),
    )


def unpacked_lines(packed: DataFrame) -> DataFrame:
    """fmt, line of every line that the bodies hold."""
    shape = payloads.batch_format(F.col("fmt"))
    inner = F.when(shape == "envelope", F.expr("substring(body, 12, length(body) - 13)")).otherwise(F.expr("substring(body, 2, length(body) - 2)"))
    # Every object begins with its timestamp, and nothing inside one does.
    lines = F.when(shape == "raw", F.split(F.expr("substring(body, 1, length(body) - 1)"), "\n")).otherwise(F.split(inner, ',(?=\\{"timestamp":)'))
    return packed.select("fmt", F.explode(lines).alias("line"))


_DIGEST = "count(*) AS n_lines, sum(('0x' || substr(md5(line), 1, 8))::BIGINT)::BIGINT AS digest, sum(('0x' || substr(md5(line), 9, 8))::BIGINT)::BIGINT AS digest2"


def _register_bodies() -> None:
    sql = O.fields(f", l AS (SELECT {_DISPATCH} AS fmt, {_DISPATCH_LINE} AS line FROM f) SELECT fmt, {_DIGEST} FROM l GROUP BY 1")
    for name, keys in (("k7_partition_bodies", None), ("k7_keyed_bodies", Z.LINE_KEYS)):

        def bodies(spark, d, keys=keys):
            """The lines that come out of the packed bodies, by an order-free digest: none lost, doubled or changed."""
            rows = mixed_lines(spark, d).select(*Z.LINE_KEYS, "fmt", "line")
            out = payloads.pack_payloads(rows, None, LIMIT, keys, 8) if keys else payloads.pack_payloads(rows.select("fmt", "line"), None, LIMIT)
            part = lambda at: F.sum(F.conv(F.substring(F.md5("line"), at, 8), 16, 10).cast("bigint"))
            return unpacked_lines(out).groupBy("fmt").agg(F.count("*").alias("n_lines"), part(1).alias("digest"), part(9).alias("digest2"))

        query(name, sql)(bodies)


_register_bodies()


@query(
    "k10_payload_types",
    f"""SELECT {KEYS}, {_DISPATCH} AS fmt, CASE {_DISPATCH} WHEN 'event' THEN 'envelope' WHEN 'json' THEN 'array' ELSE 'raw' END AS batch_format,
        CASE WHEN {_DISPATCH} IN ('event', 'json') THEN 'application/json' ELSE 'application/x-ndjson' END AS content_type FROM lineitem""",
)
def k10(spark, d):
    rows = Z.table(spark, d, "lineitem").select(*Z.LINE_KEYS, mixed_format(F.col("l_linenumber") + F.col("l_orderkey")).alias("fmt"))
    return rows.withColumns({"batch_format": payloads.batch_format(F.col("fmt")), "content_type": payloads.content_type(F.col("fmt"))})


# -- K9: attempts are line items, payloads are orders ---------------------------------------------
_ATTEMPTS = """tries AS (SELECT l_orderkey::VARCHAR AS payload_id, l_linenumber - 1 AS attempt,
        CASE l_partkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN NULL ELSE 500 END AS http_status, (l_orderkey % 1000 + 1) AS n_bytes FROM lineitem),
    counts AS (SELECT payload_id, count(*) AS attempts, count(http_status) AS responses FROM tries GROUP BY 1),
    done AS (SELECT tries.*, attempts, responses, CASE WHEN http_status BETWEEN 200 AND 299 THEN 'delivered'
        WHEN (http_status IS NULL OR http_status BETWEEN 500 AND 599) AND attempt < 3 THEN 'retry' ELSE 'dropped' END AS outcome
        FROM tries JOIN counts USING (payload_id)
        QUALIFY row_number() OVER (PARTITION BY payload_id ORDER BY attempt DESC, coalesce(http_status, 0) DESC) = 1)"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("l_partkey") % 5
    status = F.when(kind == 0, 200).when(kind == 1, 503).when(kind == 2, 404).when(kind == 4, 500)
    return Z.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("payload_id"),
        (F.col("l_linenumber") - 1).alias("attempt"),
        status.alias("http_status"),
        (F.col("l_orderkey") % 1000 + 1).alias("n_bytes"),
    )


@query(
    "k9_payload_outcomes",
    f"WITH {_ATTEMPTS} SELECT payload_id, attempts, responses, attempt AS last_attempt, http_status AS last_status, n_bytes, outcome FROM done",
)
def k9_outcomes(spark, d):
    return sinks.payload_outcomes(attempts(spark, d))


@query(
    "k9_delivery_report",
    f"""WITH {_ATTEMPTS} SELECT sum(n_bytes) FILTER (outcome = 'delivered')::BIGINT AS bytes_written, sum(responses)::BIGINT AS requests_sent,
        count(*) FILTER (outcome = 'dropped') AS requests_failed, count(*) FILTER (outcome = 'retry') AS requests_pending FROM done""",
)
def k9_report(spark, d):
    return sinks.delivery_report(attempts(spark, d))


# -- M1-M7 ----------------------------------------------------------------------------------------
HOUR = 3_600_000
_SIZED = f"s AS (SELECT *, strlen({O.JSON_LINE}) + 1 AS n_bytes FROM f)"
_SUMS = "count(*) AS logs, sum(n_bytes)::BIGINT AS bytes, count(*) FILTER (status >= 400) AS errors"


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    return render(event_rows(spark, d, "json"), "json")


@query("m1_totals", O.fields(f", s AS (SELECT *, strlen({O.COMBINED}) + 1 AS n_bytes FROM f) SELECT {_SUMS} FROM s"))
def m1(spark, d):
    return metrics.totals(render(line_rows(spark, d, "apache"), "apache"))


_BUCKETS = f", {_SIZED}, b AS (SELECT epoch_us(ts) // {HOUR * 1000} AS bucket, {_SUMS} FROM s GROUP BY 1)"


@query("m2_throughput", O.event_fields(f"{_BUCKETS} SELECT *, logs / 3600.0::DOUBLE AS logs_per_s, bytes / 3600.0::DOUBLE / 1048576 AS mb_per_s FROM b"))
def m2(spark, d):
    return metrics.throughput(json_lines(spark, d), "ts", HOUR)


@query(
    "m3_cumulative",
    O.event_fields(
        f"""{_BUCKETS} SELECT bucket, (sum(logs) OVER w)::BIGINT AS total_logs, (sum(bytes) OVER w)::BIGINT AS total_bytes, (sum(bytes) OVER w)::DOUBLE / 1048576 AS total_mb,
        (sum(bytes) OVER w)::DOUBLE / 1048576 / ((bucket - min(bucket) OVER () + 1) * 3600.0::DOUBLE) AS avg_mb_per_s FROM b WINDOW w AS (ORDER BY bucket)"""
    ),
)
def m3(spark, d):
    out = metrics.cumulative(metrics.throughput(json_lines(spark, d), "ts", HOUR), HOUR, block=64)
    return out.select("bucket", "total_logs", "total_bytes", "total_mb", "avg_mb_per_s")


_SUMMARY = f""", {_SIZED}, t AS (SELECT {_SUMS}, (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) / 1000.0::DOUBLE AS duration_s FROM s)"""


@query(
    "m4_summary",
    O.event_fields(
        f"""{_SUMMARY} SELECT *, bytes / 1048576::DOUBLE AS total_mb, bytes / 1073741824::DOUBLE AS total_gb, logs / duration_s AS avg_logs_per_s,
        errors / logs::DOUBLE * 100 AS error_pct, bytes / 1048576::DOUBLE / duration_s AS avg_mb_per_s, bytes / 1048576::DOUBLE / duration_s >= 1000 AS target_met FROM t"""
    ),
)
def m4(spark, d):
    return metrics.summary(json_lines(spark, d), "ts")


@query(
    "m5_target_check",
    O.event_fields(f"{_BUCKETS} SELECT bucket, bytes / 3600.0::DOUBLE / 1048576 >= 0.001 AS target_met FROM b"),
)
def m5(spark, d):
    out = metrics.throughput(json_lines(spark, d), "ts", HOUR)
    return out.select("bucket", metrics.target_met(F.col("mb_per_s"), 0.001).alias("target_met"))


@query(
    "m6_error_counts",
    O.fields(f"SELECT service, count(*) FILTER (status >= 400) AS http_errors, count(*) FILTER (syslog_level IN ('ERROR', 'FATAL')) AS level_errors FROM f GROUP BY 1"),
)
def m6(spark, d):
    rows = Z.table(spark, d, "lineitem").select(*Z.LINE_KEYS, F.col("l_shipdate").alias("ts"))
    rows = with_log_fields(rows, Z.LINE_KEYS, "ts", Z.SEED, Z.DIGEST, fields=["service", "status", "syslog_level"])
    return rows.groupBy("service").agg(
        F.sum(metrics.is_error().cast("bigint")).alias("http_errors"),
        F.sum(metrics.is_error_level("syslog_level").cast("bigint")).alias("level_errors"),
    )


_MONTH_FMT = _DISPATCH.replace("(l_linenumber + l_orderkey)", "event_id")
_MONTH_LINE = _DISPATCH_LINE.replace("(l_linenumber + l_orderkey)", "event_id")
# A syslog line shows a level and no status.
_MONTH_ERROR = "CASE WHEN fmt = 'syslog' THEN syslog_level IN ('ERROR', 'FATAL') ELSE status >= 400 END"


@query(
    "m7_by_state",
    _month_fields_sql(f", s AS (SELECT *, {_MONTH_FMT} AS fmt, strlen({_MONTH_LINE}) + 1 AS n_bytes FROM f) SELECT seg_lo, active_spikes, fmt, count(*) AS logs, sum(n_bytes)::BIGINT AS bytes, count(*) FILTER ({_MONTH_ERROR}) AS errors FROM s GROUP BY ALL"),
)
def m7(spark, d):
    rows = month_fields(spark, d, _fields_of(MIXED)).withColumn("fmt", mixed_format(F.col("event_id")))
    rows = render(rows, F.col("fmt"), formats=MIXED)
    return metrics.by_state(rows, ["seg_lo", "active_spikes", "fmt"], metrics.is_error_line())


# -- V1-V6: parse(render(x)) gives back the drawn fields --------------------------------------------
_PARSED = {
    "v1_parse_apache": ("apache", "ip, username, date_trunc('second', ts) AS ts, method, path, protocol, status, body_bytes, referrer, user_agent, false AS rejected"),
    "v2_parse_nginx": ("nginx", "ip, username, date_trunc('second', ts) AS ts, method, path, protocol, status, body_bytes, referrer, user_agent, request_time, false AS rejected"),
    "v3_parse_json": ("json", "make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts, level, service, trace_id, span_id, message, method, path, status, duration_ms, ip, false AS rejected"),
    "v4_parse_syslog": (
        "syslog",
        f"{O.PRI} AS priority, ts, host, service, pid, msg_id, request_id, syslog_duration_ms AS duration_ms, syslog_level AS level, {O.LEVEL_TEXT} AS message, false AS rejected",
    ),
    "v5_parse_event": ("event", f"event_epoch, service, host, {O.EVENT_LEVEL} AS level, method, path, status, duration_ms, request_size, body_bytes, false AS rejected"),
}


def _parsed(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    out = parse_lines(render(event_rows(spark, d, fmt), fmt).select("event_id", "line"), fmt)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if "ts" in out.columns else out


def _register_parsers() -> None:
    for name, (fmt, columns) in _PARSED.items():
        query(name, O.event_fields(f"SELECT event_id, {columns} FROM f"))(lambda spark, d, fmt=fmt: _parsed(spark, d, fmt))


_register_parsers()


@query(
    "v1_rejects",
    "SELECT doc_id, true AS rejected FROM documents",
)
def v1_rejects(spark, d):
    """Prose is not a log line: every document is kept and marked."""
    rows = Z.table(spark, d, "documents").select("doc_id", F.col("text").alias("line"))
    return parse_lines(rows, "apache").select("doc_id", "rejected")


@query(
    "v5_explode_events",
    O.event_fields(f"SELECT event_epoch AS timestamp, service, {O.EVENT_LEVEL} AS level, status::VARCHAR AS status, request_size::DOUBLE AS request_size FROM f"),
)
def v5_explode(spark, d):
    events = explode_events(packed(spark, d, "event"))
    tag = lambda k: F.col("tags").getItem(k).alias(k)
    return events.select("timestamp", tag("service"), tag("level"), tag("status"), F.col("metrics").getItem("request_size").alias("request_size"))


_BROKEN = (
    f"CASE WHEN event_id % 7 = 0 THEN replace({O.EVENT_LINE}, '\"timestamp\":', '\"time\":') "
    f"WHEN event_id % 11 = 0 THEN replace({O.EVENT_LINE}, '\"metrics\":', '\"numbers\":') ELSE {O.EVENT_LINE} END"
)


@query(
    "v6_ingest_report",
    O.event_fields("@").replace(
        "@",
        _pack_sql(
            f"SELECT event_id, 'event' AS fmt, {_BROKEN} AS line FROM f", "event_id", "count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0)"
        )
        + " SELECT payload_id, body AS accepted, n_rows - body AS rejected FROM p",
    ),
)
def v6(spark, d):
    rows = render(event_rows(spark, d, "event"), "event").select("event_id", "line")
    key = F.col("event_id")
    line = (
        F.when(key % 7 == 0, F.replace("line", F.lit('"timestamp":'), F.lit('"time":')))
        .when(key % 11 == 0, F.replace("line", F.lit('"metrics":'), F.lit('"numbers":')))
        .otherwise(F.col("line"))
    )
    buckets = Z.table(spark, d, "events").count() // 5000 + 1
    return ingest_report(payloads.pack_payloads(rows.withColumn("line", line), "event", LIMIT, Z.EVENT_KEYS, buckets))


# -- G3 -------------------------------------------------------------------------------------------
_SHARES = {
    "method": {"GET": 156, "POST": 51, "PUT": 20, "DELETE": 12, "PATCH": 10, "HEAD": 5, "OPTIONS": 2},
    "level": {"DEBUG": 12, "INFO": 181, "WARN": 38, "ERROR": 20, "FATAL": 5},
    "protocol": {"HTTP/1.0": 64, "HTTP/1.1": 128, "HTTP/2.0": 64},
}


def _audit_sql() -> str:
    parts = []
    for field, shares in _SHARES.items():
        column = "drawn_level" if field == "level" else field
        cases = " ".join(f"WHEN {O.q(v)} THEN {n / 256.0}::DOUBLE" for v, n in shares.items())
        parts.append(f"SELECT '{field}' AS field, {column} AS value, count(*) AS observed, CASE {column} {cases} END * (SELECT count(*) FROM lineitem)::DOUBLE AS expected FROM f GROUP BY {column}")
    return O.fields(f", o AS ({' UNION ALL '.join(parts)}) SELECT *, (observed - expected) * (observed - expected) / expected AS chi2_term FROM o")


@query("g3_distribution_audit", _audit_sql())
def g3(spark, d):
    from ..functions import fields as X
    from ..functions.draws import Draws

    rows = Z.table(spark, d, "lineitem").select(*Z.LINE_KEYS)
    r = Draws(Z.LINE_KEYS, Z.SEED, Z.DIGEST)
    drawn = {"method": X.http_method(r), "level": X.log_level(r), "protocol": X.protocol(r)}
    out = None
    for field, column in drawn.items():
        part = audit.audit_distribution(rows, field, column).select(F.lit(field).alias("field"), "value", "observed", "expected", "chi2_term")
        out = part if out is None else out.unionByName(part)
    return out


def _slots(runs: list[tuple[int, object]], rest: object) -> dict[str, int]:
    """Slots per value of cumulative bounds; the left-over ones go to ``rest``."""
    out, at = {}, 0
    for hi, value in [*runs, (256, rest)]:
        out[str(value)] = out.get(str(value), 0) + hi - at
        at = hi
    return out


_ALL_SHARES = _SHARES | {
    "service": dict.fromkeys(O.V.SERVICES, 32),
    "host": dict.fromkeys(O.V.HOSTS, 32),
    "referrer": {"-": 154} | {site: 15 if n < 4 else 14 for n, site in enumerate(O.V.REFERRERS)},
    "username": {"-": 128} | dict.fromkeys(O.V.USERNAMES, 4),
    "success_status": _slots(*O.SUCCESS), "client_status": _slots(*O.CLIENT), "server_status": _slots(*O.SERVER),
}


def _audit_all_sql() -> str:
    classes = """CASE WHEN starts_with(ip, '10.') THEN '10/8' WHEN starts_with(ip, '192.168.') THEN '192.168/16'
            WHEN regexp_matches(ip, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') THEN '172.16/12' ELSE 'public' END AS address_class,
        CASE WHEN regexp_matches(path, '^/static/[0-9a-f]{8}\\.') THEN 'asset' WHEN regexp_matches(path, '^/api/v1/[a-z]+/[0-9a-f]{8}-') THEN 'resource'
            WHEN contains(path, '?page=') THEN 'listing' WHEN path IN (%s) THEN 'simple' ELSE 'page' END AS path_class, user_agent""" % ", ".join(O.q(p) for p in O.V.SIMPLE_PATHS)
    pooled = ("address_class", "path_class", "user_agent")
    # The pools by their slots: 65,536 is a multiple of each pool's size.
    pool = O.field_ctes("SELECT unnest(range(65536)) AS slot, TIMESTAMP '2024-01-01' AS ts", "slot")
    for index, slot in ((O.cut("h0", 0, 0, 16), "slot"), (O.cut("h0", 0, 16, 16) + " % 4096", "slot % 4096"), (O.cut("h0", 0, 32, 8), "slot % 256")):
        pool = pool.replace(f", {index}))", f", {slot}))")
    given = ", ".join(f"({O.q(f)}, {O.q(v)}, {n}::DOUBLE / 256)" for f, shares in _ALL_SHARES.items() for v, n in shares.items())
    code = {"success_status": "status < 400", "client_status": "status BETWEEN 400 AND 499", "server_status": "status >= 500"}
    column = lambda f: "drawn_level" if f == "level" else f"CASE WHEN {code[f]} THEN status::VARCHAR END" if f in code else f
    values = " UNION ALL ".join(f"SELECT {O.q(f)} AS field, {column(f)} AS value FROM k" for f in (*_ALL_SHARES, *pooled))
    shares = " UNION ALL ".join(f"SELECT {O.q(f)}, {f}, count(*)::DOUBLE / 65536 FROM pool GROUP BY 2" for f in pooled)
    return O.fields(f""", pool AS (WITH {pool} SELECT {classes} FROM f), k AS MATERIALIZED (SELECT * EXCLUDE (user_agent), {classes} FROM f),
        n AS (SELECT field, value, count(*) AS observed FROM ({values}) WHERE value IS NOT NULL GROUP BY ALL),
        s(field, value, share) AS (SELECT * FROM (VALUES {given}) UNION ALL {shares}),
        e AS (SELECT field, value, coalesce(observed, 0) AS observed, share * (sum(observed) OVER (PARTITION BY field))::DOUBLE AS expected FROM n FULL JOIN s USING (field, value)),
        c AS (SELECT *, (observed - expected) * (observed - expected) / expected AS chi2_term FROM e),
        x AS (SELECT *, sum(chi2_term) OVER (PARTITION BY field) AS chi2, count(*) OVER (PARTITION BY field) - 1 AS dof FROM c)
        SELECT *, round(1 - list_sum(list_transform(range(1500), lambda n: exp((dof / 2::DOUBLE + n) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2::DOUBLE + n + 1)))), 6) AS p_value FROM x""")


@query("g3_all_fields", _audit_all_sql())
def g3_all(spark, d):
    """Every drawn field in one pass, with the probability of a deviation like this."""
    from ..functions import fields as X
    from ..functions.draws import Draws

    names = [f for f in audit.SLOT_FIELDS if f != "level" and f not in audit.STATUS_CODES]
    rows = Z.table(spark, d, "lineitem").select(*Z.LINE_KEYS, F.col("l_shipdate").alias("ts"))
    rows = with_log_fields(rows, Z.LINE_KEYS, "ts", Z.SEED, Z.DIGEST, fields=[*names, "status", "ip", "path", "user_agent"])
    rows = rows.withColumn("level", X.log_level(Draws(Z.LINE_KEYS, Z.SEED, Z.DIGEST)))
    out = audit.audit_fields(rows, audit.audited(F.col("status")), Z.SEED, Z.DIGEST)
    return out.withColumn("p_value", F.round("p_value", 6))
