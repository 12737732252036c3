"""Whole runs over the customers' scripts on the short clock, and runs of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, run
from . import fixtures as X
from . import oracle_parts as O
from .output_queries import MIXED
from .registry import query
from .scenario_queries import BUCKET, BUDGET_CTES

LIMIT = 4_096
KEYS = "sid, bucket, i"
_LINE = f"CASE fmt WHEN 'apache' THEN {O.COMBINED} WHEN 'json' THEN {O.JSON_LINE} WHEN 'syslog' THEN {O.SYSLOG_LINE} WHEN 'event' THEN {O.EVENT_LINE} ELSE {O.NGINX_LINE} END"
_ERROR = "CASE WHEN fmt = 'syslog' THEN syslog_level IN ('ERROR', 'FATAL') ELSE status >= 400 END"


def _lines_ctes(rate: str) -> str:
    """From ``src`` rows with a format to ``l``, the rendered lines."""
    fields = O.field_ctes(f"SELECT {KEYS}, t, ts, fmt, {rate} AS rate, spike_active FROM a", KEYS, rate="rate")
    return f"{fields}, l AS MATERIALIZED (SELECT sid, bucket, i, t, ts, fmt, spike_active, {_ERROR} AS is_error, {_LINE} AS line, strlen({_LINE}) + 1 AS n_bytes FROM f)"


def _run_sql(select: str) -> str:
    rows = f"""WITH {BUDGET_CTES}, g AS (SELECT scenario_id AS sid, bucket, n_rows, unnest(range(n_rows)) AS i FROM budget WHERE n_rows > 0),
        g2 AS (SELECT sid, bucket, i, bucket * {BUCKET} + i * {BUCKET} // n_rows AS t FROM g)
        SELECT *, make_timestamp((epoch_ms(TIMESTAMP '{X.CUSTOMER_ORIGIN}') + t) * 1000) AS ts,
            [{', '.join(O.q(f) for f in MIXED)}, 'apache'][sid::BIGINT % 6 + 1] AS fmt FROM g2"""
    attached = O.state_ctes(O.SHORT_CONTROL, rows, KEYS, O.short_preset)
    for old, new in (("a0 AS", "at0 AS"), ("FROM a0", "FROM at0"), ("a0.*", "at0.*")):
        attached = attached.replace(old, new)
    return f"WITH RECURSIVE {attached}, {_lines_ctes('(error_fp::FLOAT / 10000::FLOAT)')} {select}"


def run_control(spark: SparkSession, d: str):
    """The short scripts, each with one of five formats or none."""
    control = X.short_control(spark, d)
    fmt = F.get(F.array(*[F.lit(f) for f in MIXED]), (F.col("scenario_id").cast("bigint") % 6).cast("int"))
    return control.with_(meta=control.meta.withColumn("format", fmt))


def run_lines(spark: SparkSession, d: str) -> DataFrame:
    return run.run_rows(run_control(spark, d), X.CUSTOMER_ORIGIN, X.SEED, X.DIGEST, BUCKET)


@query("run_totals", _run_sql("SELECT fmt, spike_active, count(*) AS logs, sum(n_bytes)::BIGINT AS bytes, count(*) FILTER (is_error) AS errors FROM l GROUP BY ALL"))
def run_totals(spark, d):
    """Scripts to totals: every planned row, at the error rate of its own time, in five formats."""
    return run.run_totals(run_lines(spark, d))


def _pack_sql(limit: str, window: int) -> str:
    joined = lambda sep: f"string_agg(line, {sep} ORDER BY bucket, i)"
    body = f"""CASE fmt WHEN 'event' THEN '{{"events":[' || {joined("','")} || ']}}' WHEN 'json' THEN '[' || {joined("','")} || ']' ELSE {joined('chr(10)')} || chr(10) END"""
    return f"""c AS (SELECT *, bucket // {window} AS win, i // {run.BLOCK_ROWS} AS blk,
        (sum(n_bytes) OVER (PARTITION BY sid, bucket // {window}, i // {run.BLOCK_ROWS} ORDER BY bucket, i ROWS UNBOUNDED PRECEDING) - n_bytes) // {limit} AS batch FROM l),
    p AS (SELECT sid || '-' || win || '-' || blk || '-' || batch AS payload_id, sid AS scenario_id, fmt, count(*) AS n_rows, {body} AS body FROM c GROUP BY sid, win, blk, batch, fmt)"""


_PAYLOADS = "payload_id, scenario_id, fmt, n_rows, strlen(body) AS n_bytes, md5(body) AS body_md5"


@query("run_payloads", _run_sql(f", {_pack_sql(str(LIMIT), 30)} SELECT {_PAYLOADS} FROM p"))
def run_payloads(spark, d):
    """Scripts to payloads, bodies compared whole."""
    out = run.run_payloads(run_lines(spark, d), LIMIT, window_buckets=30)
    return out.select("payload_id", "scenario_id", "fmt", "n_rows", "n_bytes", F.md5("body").alias("body_md5"))


# -- M2, M3 without holes ---------------------------------------------------------------------------
_HALVES = f"""half AS (SELECT sid, epoch_us(ts) // {metrics.INTERVAL_MS * 1000} AS bucket, count(*) AS logs, sum(n_bytes)::BIGINT AS bytes, count(*) FILTER (is_error) AS errors FROM l GROUP BY ALL),
    every AS (SELECT sid, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM half GROUP BY sid),
    d AS (SELECT sid AS scenario_id, bucket, coalesce(logs, 0) AS logs, coalesce(bytes, 0) AS bytes, coalesce(errors, 0) AS errors FROM every LEFT JOIN half USING (sid, bucket))"""


@query(
    "m2_dense_intervals",
    _run_sql(f", {_HALVES} SELECT *, logs / 0.5::DOUBLE AS logs_per_s, bytes / 0.5::DOUBLE / 1048576 AS mb_per_s, (sum(logs) OVER w)::BIGINT AS total_logs, (sum(bytes) OVER w)::BIGINT AS total_bytes FROM d WINDOW w AS (PARTITION BY scenario_id ORDER BY bucket)"),
)
def m2_dense(spark, d):
    """A report every 500 ms and scenario, also of intervals in which nothing came."""
    rows = run_lines(spark, d)
    out = metrics.throughput(rows, "ts", error=F.col("is_error"), by=["scenario_id"], dense=True)
    return metrics.running_totals(out, by=["scenario_id"], block=16)


# -- runs of requests -------------------------------------------------------------------------------
def run_texts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests of one to three seconds at one to seven logs a second, some of them refused."""
    key = F.col("o_orderkey")
    fmt = F.get(F.array(*[F.lit(f) for f in MIXED]), (key % 5).cast("int"))
    text = F.concat(
        F.lit('{"output":"https://sink.invalid/'), F.col("o_custkey"), F.lit('","duration":"'), key % 3 + 1, F.when(key % 13 == 0, "x").otherwise("s"),
        F.lit('","rate":{"throughput_mb":1,"logs_per_sec":'), key % 7 + 1, F.lit('},"format":"'), fmt, F.lit('","http_batch_kb":'), key % 2 + 1, F.lit("}"),
    )
    return X.table(spark, d, "orders").select(key.alias("request_id"), text.alias("json"))


_REQUEST_RUN = f"""WITH o AS (SELECT o_orderkey AS k, 'https://sink.invalid/' || o_custkey AS url, (k % 3 + 1) * 1000 AS total, k % 7 + 1 AS lps FROM orders WHERE k % 13 <> 0),
    g AS (SELECT k, url, unnest(range(total // 1000)) AS bucket, lps FROM o), a0_ AS (SELECT *, unnest(range(lps)) AS i FROM g),
    a AS (SELECT k::VARCHAR AS sid, url, k % 2 + 1 AS kb, bucket, i, bucket * 1000 + i * 1000 // lps AS t, false AS spike_active, [{', '.join(O.q(f) for f in MIXED)}][k % 5 + 1] AS fmt,
        make_timestamp((epoch_ms(TIMESTAMP '{X.CUSTOMER_ORIGIN}') + bucket * 1000 + i * 1000 // lps) * 1000) AS ts FROM a0_),
    {_lines_ctes('(trunc(0.01::FLOAT * 10000::FLOAT)::INT::FLOAT / 10000::FLOAT)')}, lim AS (SELECT DISTINCT sid, kb, url FROM a),
    {_pack_sql('(kb * 1024)', 60).replace('FROM l)', 'FROM l JOIN lim USING (sid))').replace('fmt, count(*)', 'fmt, url, count(*)').replace('batch, fmt)', 'batch, fmt, url)')}
    SELECT {_PAYLOADS}, url FROM p"""


@query("run_requests", _REQUEST_RUN)
def run_requests(spark, d):
    """Requests to payloads, each at its own rate, format, target and batch limit; refused ones make none."""
    out = run.run_requests(run_texts(spark, d), "json", "request_id", X.CUSTOMER_ORIGIN, X.SEED, X.DIGEST, window_buckets=60)
    return out["payloads"].select("payload_id", "scenario_id", "fmt", "n_rows", "n_bytes", F.md5("body").alias("body_md5"), "url")
