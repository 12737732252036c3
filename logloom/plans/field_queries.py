"""Queries over draws, fields and text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import text as T
from ..functions.draws import Draws, pool_lookup, weighted_slots
from ..sources.rows import with_log_fields
from . import fixtures as Z
from . import oracle_parts as O
from .registry import query

_H = lambda i, keys=O.LINE_KEYS: O.digest("row", i, keys)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return Z.table(spark, d, "lineitem").select(*Z.LINE_KEYS, "l_shipdate")


def line_draws() -> Draws:
    return Draws(Z.LINE_KEYS, Z.SEED, Z.DIGEST)


def line_fields(spark: SparkSession, d: str, *names: str) -> DataFrame:
    out = with_log_fields(lines(spark, d), Z.LINE_KEYS, "l_shipdate", Z.SEED, Z.DIGEST, fields=names or None)
    return out.select(*Z.LINE_KEYS, *names)


def _register(name: str, *columns: str) -> None:
    sql = O.fields(f"SELECT {O.LINE_KEYS}, {', '.join(columns)} FROM f")
    query(name, sql)(lambda spark, d: line_fields(spark, d, *columns))


# -- D1, D2, D18 ----------------------------------------------------------------------------------
@query(
    "d1_uniform_draws",
    f"""WITH h AS (SELECT {O.LINE_KEYS}, {_H(0)} AS h0, {_H(2)} AS h2 FROM lineitem)
    SELECT {O.LINE_KEYS}, {O.cut('h0', 0, 8, 8)} AS u8, {O.cut('h0', 0, 16, 16)} AS u16, {O.cut('h0', 1, 32, 32)} AS u32, {O.hexcut('h2', 4, 0, 64)} AS u64_hex,
        ({O.cut('h0', 1, 0, 24)}::DOUBLE / 16777216)::FLOAT AS unit, {O.cut('h0', 0, 32, 8)} >= 128 AS coin, {O.cut('h2', 5, 0, 32)} % 999 AS below FROM h""",
)
def d1(spark, d):
    r = line_draws()
    return lines(spark, d).select(
        *Z.LINE_KEYS, r.u8(0, 8).alias("u8"), r.u16(0, 16).alias("u16"), r.u32(1, 32).alias("u32"), r.hex_digits(4, 0, 64).alias("u64_hex"),
        r.unit(1, 0).alias("unit"), r.coin(0, 32).alias("coin"), r.below(5, 0, 999).alias("below"),
    )


@query(
    "d2_weighted_choice",
    f"""WITH n AS (SELECT event_type AS v, count(*) AS c FROM events GROUP BY 1), t AS (SELECT sum(c) AS total FROM n),
    s AS (SELECT v, floor(c * 256 / total)::BIGINT AS k FROM n, t), b AS (SELECT v, sum(k) OVER (ORDER BY v) AS hi, k FROM s),
    r AS (SELECT {O.LINE_KEYS}, {O.cut(_H(0), 0, 0, 8)} AS slot FROM lineitem)
    SELECT {O.LINE_KEYS}, coalesce((SELECT v FROM b WHERE slot >= hi - k AND slot < hi), (SELECT min(v) FROM n)) AS value FROM r""",
)
def d2(spark, d):
    counts = Z.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    slots = weighted_slots(counts, "event_type", "n", 256, "event_type")
    # One row per slot: 256 rows by construction.
    table = slots.select(F.explode(F.sequence("slot_lo", F.col("slot_hi") - 1)).alias("slot"), "value")
    return pool_lookup(lines(spark, d), table, line_draws().u8(0, 0), size=256).select(*Z.LINE_KEYS, "value")


@query(
    "d18_pool_lookup",
    f"""WITH n AS (SELECT count(*) AS c FROM pages), r AS (SELECT event_id, {O.cut(_H(1, O.EVENT_KEYS), 2, 0, 32)} AS u FROM events)
    SELECT event_id, url FROM r, n JOIN pages ON page_id = u % c""",
)
def d18(spark, d):
    pool = Z.table(spark, d, "pages").select(F.col("page_id").alias("slot"), "url")
    rows = Z.table(spark, d, "events").select("event_id")
    return pool_lookup(rows, pool, Draws(Z.EVENT_KEYS, Z.SEED, Z.DIGEST).u32(2, 0)).select("event_id", "url")


# -- D3-D17 ---------------------------------------------------------------------------------------
_register("d3_http_status", "status")
_register("d4_http_method", "method")
_register("d5_protocol", "protocol")
_register("d6_referrer", "referrer")
_register("d8_service", "service")
_register("d9_host", "host")
_register("d10_username", "username")
_register("d11_response_size", "status", "body_bytes")
_register("d12_ip_address", "ip")
_register("d13_url_path", "path")
_register("d14_user_agent", "user_agent")
_register("d15a_request_seconds", "status", "request_time")
_register("d15b_duration_ms", "status", "duration_ms")
_register("d15c_syslog_duration", "syslog_duration_ms")
_register("d16_hex_ids", "trace_id", "span_id", "request_id", "msg_id")
_register("d17_sizes_and_pids", "request_size", "pid")
_register("t8_level_from_status", "status", "level")
_register("t9_status_message", "status", "message")
_register("t10_syslog_level", "syslog_level")


@query("d7_log_level", O.fields(f"SELECT {O.LINE_KEYS}, drawn_level AS level FROM f"))
def d7(spark, d):
    return lines(spark, d).select(*Z.LINE_KEYS, X.log_level(line_draws()).alias("level"))


_EVENT_COLUMNS = ["ip", "username", "method", "path", "status", "body_bytes", "request_time", "level", "service", "message", "event_epoch"]


@query("r6_event_fields", O.event_fields(f"SELECT event_id, {', '.join(_EVENT_COLUMNS)} FROM f", "0.3::FLOAT"))
def r6(spark, d):
    rows = Z.table(spark, d, "events").select("event_id", "ts")
    return with_log_fields(rows, Z.EVENT_KEYS, "ts", Z.SEED, Z.DIGEST, error_rate=0.3).select("event_id", *_EVENT_COLUMNS)


# -- T1-T7, T11-T13 -------------------------------------------------------------------------------
def _events(spark: SparkSession, d: str, **columns: Column) -> DataFrame:
    return Z.table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in columns.items()])


@query("t1_apache_time", "SELECT event_id, strftime(ts, '[%d/%b/%Y:%H:%M:%S +0000]') AS text FROM events")
def t1(spark, d):
    return _events(spark, d, text=T.apache_ts("ts"))


@query("t2_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS text FROM events")
def t2(spark, d):
    return _events(spark, d, text=T.iso_ts("ts"))


@query("t3_syslog_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS text FROM events")
def t3(spark, d):
    return _events(spark, d, text=T.syslog_ts("ts"))


@query("t4_epoch_jitter", O.event_fields("SELECT event_id, event_epoch FROM f"))
def t4(spark, d):
    return _events(spark, d, event_epoch=T.epoch_jitter("ts", Draws(Z.EVENT_KEYS, Z.SEED, Z.DIGEST)))


@query(
    "t5_civil_date",
    f"""WITH t AS (SELECT {O.LINE_KEYS}, (l_orderkey * 86399 + l_partkey * 7)::BIGINT AS s FROM lineitem), c AS (SELECT *, make_timestamp(s * 1000000) AS ts FROM t)
    SELECT {O.LINE_KEYS}, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second FROM c""",
)
def t5(spark, d):
    epoch = F.col("l_orderkey") * 86399 + F.col("l_partkey") * 7
    rows = Z.table(spark, d, "lineitem").select(*Z.LINE_KEYS, T.civil_date(epoch).alias("c"))
    return rows.select(*Z.LINE_KEYS, "c.*")


@query("t6_coarse_time", "SELECT event_id, (epoch_us(ts) // 50000) * 50 AS coarse_ms FROM events")
def t6(spark, d):
    return _events(spark, d, coarse_ms=F.unix_millis(T.coarse_ts("ts", 50)))


@query(
    "t7_json_escape",
    r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) AS digest,
        length(replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) AS n FROM documents""",
)
def t7(spark, d):
    text = T.json_escape("text")
    return Z.table(spark, d, "documents").select("doc_id", F.md5(text).alias("digest"), F.length(text).alias("n"))


@query("t11_priority", O.fields(f"SELECT {O.LINE_KEYS}, syslog_level, {O.PRI} - 128 AS severity, {O.PRI} AS priority FROM f"))
def t11(spark, d):
    rows = line_fields(spark, d, "syslog_level")
    return rows.withColumns({"severity": T.severity("syslog_level"), "priority": T.priority("syslog_level")})


@query("t12_level_message", O.fields(f"SELECT {O.LINE_KEYS}, syslog_level, {O.LEVEL_TEXT} AS message FROM f"))
def t12(spark, d):
    return line_fields(spark, d, "syslog_level").withColumn("message", T.level_message("syslog_level"))


@query("t13_line_bytes", "SELECT doc_id, strlen(text) + 1 AS n_bytes FROM documents")
def t13(spark, d):
    return Z.table(spark, d, "documents").select("doc_id", T.line_bytes("text").alias("n_bytes"))
