"""Queries over scenario operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import duration_ms, duration_ok, est_throughput_mb, rate_lps
from ..operators import audit, budget
from ..operators.attach import States, attach_scenario, inject_anomalies
from ..operators.spikes import expand_spikes, spike_transitions, trigger_order
from ..operators.states import controller_fixed_point
from ..operators.timeline import resolve_presets, timeline_segments
from ..sources.requests import expand_requests, validate_requests
from ..sources.rows import generate_rows
from ..sources.scenarios import override_scenario
from . import fixtures as X
from . import oracle_parts as O
from .registry import query


def month_rows(spark: SparkSession, d: str, describe: bool = False) -> DataFrame:
    return attach_scenario(X.table(spark, d, "events"), X.month_states(spark, describe), "ts", X.MONTH_ORIGIN)


def customer_rows(spark: SparkSession, d: str, describe: bool = False) -> DataFrame:
    return attach_scenario(
        X.customer_rows(spark, d), X.customer_states(spark, d, describe), "l_shipdate", X.CUSTOMER_ORIGIN, "custkey"
    )


# -- S1, S2, S4: text functions on texts made from lineitem ------------------------------------
def _text(kind: Column, *choices: Column) -> Column:
    out = None
    for i, c in enumerate(choices):
        out = F.when(kind == i, c) if out is None else out.when(kind == i, c)
    return out


def duration_texts(spark: SparkSession, d: str) -> DataFrame:
    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    text = _text(
        (F.col("l_orderkey") + n) % 12,
        F.concat(n, F.lit("h"), s % 60, F.lit("m"), p % 60, F.lit("s")),
        (s % 1000).cast("string"),
        F.concat(n, F.lit("."), p % 10, F.lit("s")),
        F.concat(F.lit("-"), n, F.lit("s")),
        F.concat(p, F.lit("ms")),
        F.concat(n, F.lit("d")),
        F.lit(""),
        F.lit("--"),
        F.concat(n, F.lit("H")),
        F.lit("s"),
        F.concat(F.lit("  "), n, F.lit("m"), p % 60),
        F.concat(n, F.lit("S "), s, F.lit("M")),
    )
    return X.table(spark, d, "lineitem").select(*X.LINE_KEYS, text.alias("text"))


_DURATION_TEXT = """CASE (l_orderkey + l_linenumber) % 12
    WHEN 0 THEN l_linenumber || 'h' || (l_suppkey % 60) || 'm' || (l_partkey % 60) || 's' WHEN 1 THEN (l_suppkey % 1000)::VARCHAR
    WHEN 2 THEN l_linenumber || '.' || (l_partkey % 10) || 's' WHEN 3 THEN '-' || l_linenumber || 's' WHEN 4 THEN l_partkey || 'ms'
    WHEN 5 THEN l_linenumber || 'd' WHEN 6 THEN '' WHEN 7 THEN '--' WHEN 8 THEN l_linenumber || 'H' WHEN 9 THEN 's'
    WHEN 10 THEN '  ' || l_linenumber || 'm' || (l_partkey % 60) ELSE l_linenumber || 'S ' || l_suppkey || 'M' END"""


@query(
    "s1_duration_ms",
    f"""WITH t AS (SELECT {O.LINE_KEYS}, {_DURATION_TEXT} AS text FROM lineitem),
    c AS (SELECT *, lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS x FROM t),
    k AS (SELECT *, trim(text) <> '' AND regexp_full_match(x, '([0-9]+[hms])*([0-9]+)?') AS ok,
        coalesce(list_sum(regexp_extract_all(x, '([0-9]+)h', 1)::BIGINT[]), 0) AS h, coalesce(list_sum(regexp_extract_all(x, '([0-9]+)m', 1)::BIGINT[]), 0) AS m,
        coalesce(list_sum(regexp_extract_all(x, '([0-9]+)s', 1)::BIGINT[]), 0) AS s, coalesce(nullif(regexp_extract(x, '([0-9]+)$', 1), '')::BIGINT, 0) AS rest FROM c)
    SELECT {O.LINE_KEYS}, text, ok, CASE WHEN ok THEN (h * 3600000 + m * 60000 + s * 1000 + rest * 1000)::BIGINT END AS ms FROM k""",
)
def s1(spark, d):
    return duration_texts(spark, d).withColumns({"ok": duration_ok("text"), "ms": duration_ms("text")})


@query(
    "s2_rate_text",
    f"""WITH t AS (SELECT {O.LINE_KEYS}, CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN 'low' WHEN 1 THEN 'Full' WHEN 2 THEN 'max' WHEN 3 THEN l_partkey::VARCHAR
        WHEN 4 THEN l_partkey || 'K' WHEN 5 THEN l_suppkey || 'm' WHEN 6 THEN l_linenumber || '.5M' WHEN 7 THEN 'K' ELSE l_partkey || 'k' END AS text FROM lineitem)
    SELECT {O.LINE_KEYS}, text, CASE text WHEN 'low' THEN 500000 WHEN 'max' THEN 10000000 ELSE
        CASE WHEN regexp_full_match(text, '[0-9]+') THEN text::BIGINT WHEN regexp_full_match(text, '[0-9]+[Kk]') THEN left(text, -1)::BIGINT * 1000
             WHEN regexp_full_match(text, '[0-9]+[Mm]') THEN left(text, -1)::BIGINT * 1000000 END END AS lps FROM t""",
)
def s2(spark, d):
    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    text = _text(
        (F.col("l_orderkey") + n) % 9,
        F.lit("low"), F.lit("Full"), F.lit("max"), p.cast("string"), F.concat(p, F.lit("K")), F.concat(s, F.lit("m")),
        F.concat(n, F.lit(".5M")), F.lit("K"), F.concat(p, F.lit("k")),
    )
    return X.table(spark, d, "lineitem").select(*X.LINE_KEYS, text.alias("text")).withColumn("lps", rate_lps("text"))


@query(
    "s4_estimated_mb",
    f"SELECT {O.LINE_KEYS}, ceil((l_partkey * 1000 + l_suppkey)::DOUBLE * 200 / 1048576)::BIGINT AS mb FROM lineitem",
)
def s4(spark, d):
    lps = F.col("l_partkey") * 1000 + F.col("l_suppkey")
    return X.table(spark, d, "lineitem").select(*X.LINE_KEYS, est_throughput_mb(lps).alias("mb"))


# -- S3, S5, S6, S7: timelines of all customers -------------------------------------------------
def customer_rates(spark: SparkSession, d: str) -> DataFrame:
    """Overrides: every fifth customer redefines low, every seventh medium."""
    ids = X.table(spark, d, "orders").select("o_custkey").distinct()
    key = F.col("o_custkey")
    low = ids.filter(key % 5 == 0).select(key.cast("string").alias("scenario_id"), F.lit("low").alias("rate_name"), (key % 90 + 1).cast("int").alias("mb"), (key * 10 + 1).cast("bigint").alias("lps"))
    medium = ids.filter(key % 7 == 0).select(key.cast("string").alias("scenario_id"), F.lit("medium").alias("rate_name"), (key % 300 + 1).cast("int").alias("mb"), (key * 100 + 7).cast("bigint").alias("lps"))
    return low.unionByName(medium)


@query(
    "s3_presets",
    f"""WITH {O.CUSTOMER_CONTROL},
    n AS (SELECT *, replace(rate, 'ramp_to_', '') AS name, sid::BIGINT AS c FROM tl)
    SELECT sid AS scenario_id, idx, starts_with(rate, 'ramp_to_') AS is_ramp,
        CASE WHEN name = 'full' THEN 5000000 WHEN name = 'high' THEN 3750000 WHEN name = 'low' THEN CASE WHEN c % 5 = 0 THEN c * 10 + 1 ELSE 500000 END
             ELSE CASE WHEN c % 7 = 0 THEN c * 100 + 7 ELSE 2500000 END END AS target_lps,
        CASE WHEN name = 'full' THEN 1000 WHEN name = 'high' THEN 750 WHEN name = 'low' THEN CASE WHEN c % 5 = 0 THEN c % 90 + 1 ELSE 100 END
             ELSE CASE WHEN c % 7 = 0 THEN c % 300 + 1 ELSE 500 END END AS target_mb FROM n""",
)
def s3(spark, d):
    timeline = X.customer_control(spark, d).timeline
    return resolve_presets(timeline, customer_rates(spark, d)).select("scenario_id", "idx", "is_ramp", "target_lps", "target_mb")


_SEGMENTS = f"WITH RECURSIVE {O.walk_ctes(O.CUSTOMER_CONTROL)}"


@query("s5_segments", f"{_SEGMENTS} SELECT sid AS scenario_id, lo AS lo_ms, hi AS hi_ms, yl AS end_lps, yb AS end_bps FROM seg")
def s5(spark, d):
    return timeline_segments(X.customer_control(spark, d)).select("scenario_id", "lo_ms", "hi_ms", "end_lps", "end_bps")


@query("s6_ramp_starts", f"{_SEGMENTS} SELECT sid AS scenario_id, lo AS lo_ms, rms AS ramp_ms, xl AS start_lps, yl AS end_lps, xb AS start_bps FROM seg")
def s6(spark, d):
    return timeline_segments(X.customer_control(spark, d)).select("scenario_id", "lo_ms", "ramp_ms", "start_lps", "end_lps", "start_bps")


@query("s6_ramp_rows_month", O.month("SELECT event_id, t AS t_ms, lps, bps, ramping FROM a"))
def s6_rows(spark, d):
    return month_rows(spark, d).select("event_id", "t_ms", "lps", "bps", "ramping")


@query("s6_ramp_rows", O.customer(f"SELECT {O.LINE_KEYS}, t AS t_ms, lps, bps, ramping FROM a"))
def s6_customer_rows(spark, d):
    return customer_rows(spark, d).select(*X.LINE_KEYS, "t_ms", "lps", "bps", "ramping")


@query("s7_base_error", f"{_SEGMENTS} SELECT sid AS scenario_id, lo AS lo_ms, err AS base_error FROM seg")
def s7(spark, d):
    return timeline_segments(X.customer_control(spark, d)).select("scenario_id", "lo_ms", "base_error")


# -- S8-S11: spike instances of all customers ---------------------------------------------------
_INSTANCES = f"WITH {O.CUSTOMER_CONTROL}, {O.spike_ctes()}"


def instances(spark: SparkSession, d: str) -> DataFrame:
    return expand_spikes(X.customer_control(spark, d).spikes, X.SEED, X.DIGEST)


@query("s8_spike_repeats", f"{_INSTANCES} SELECT sid AS scenario_id, idx AS spike_idx, rep, type, dur AS length_ms, latency FROM inst")
def s8(spark, d):
    return instances(spark, d).select(
        "scenario_id", "spike_idx", "rep", "type", (F.col("end_ms") - F.col("start_ms")).alias("length_ms"), "latency"
    )


@query("s9_spike_jitter", f"{_INSTANCES} SELECT sid AS scenario_id, idx AS spike_idx, rep, s AS start_ms, s + dur AS end_ms FROM inst")
def s9(spark, d):
    return instances(spark, d).select("scenario_id", "spike_idx", "rep", "start_ms", "end_ms")


@query("s10_spike_error", f"{_INSTANCES} SELECT sid AS scenario_id, idx AS spike_idx, rep, error FROM inst")
def s10(spark, d):
    return instances(spark, d).select("scenario_id", "spike_idx", "rep", "error")


@query("s11_trigger_order", f"{_INSTANCES} SELECT sid AS scenario_id, s AS start_ms, idx AS spike_idx, rep, type FROM inst ORDER BY ALL")
def s11(spark, d):
    return trigger_order(instances(spark, d)).select("scenario_id", "start_ms", "spike_idx", "rep", "type")


@query(
    "w3_spike_transitions",
    f"""{_INSTANCES}, c AS (SELECT inst.*, total FROM inst JOIN meta USING (sid))
    SELECT sid AS scenario_id, idx AS spike_idx, rep, type, greatest(s, 0) AS at_ms, 'enter' AS change FROM c WHERE dur > 0 AND s < total AND s + dur > 0
    UNION ALL SELECT sid, idx, rep, type, s + dur, 'exit' FROM c WHERE dur > 0 AND s + dur > 0 AND s + dur < total""",
)
def w3(spark, d):
    return spike_transitions(instances(spark, d), X.customer_control(spark, d).meta)


# -- S12-S18: state at row times ------------------------------------------------------------------
_STATE_QUERIES = {
    "s12_active_spikes": ["n_active", "spike_active"],
    "s13_combined_effect": ["spike_error", "latency_multiplier", "unusual"],
    "s14_effective_error": ["base_error", "spike_error", "effective_error"],
    "s15_quantized_error": ["error_fp", "error_rate", "clamped_fp", "latency_fp"],
    "s16_progress": ["t_ms", "remaining_ms", "progress_pct"],
    "s17_descriptions": ["rate_desc", "active_spikes"],
    "s18_attach": ["seg_lo", "lps", "bps", "base_error", "n_active", "effective_error", "error_fp", "spike_active"],
}
_F32 = lambda ms: f"(({ms}) // 1000)::FLOAT + (({ms}) % 1000 * 1000000)::FLOAT / 1e9::FLOAT"
_STATE_SQL = {
    "error_rate": "(error_fp::FLOAT / 10000::FLOAT)",
    "clamped_fp": "trunc(least(effective_error, 1::FLOAT) * 10000::FLOAT)::INT",
    "latency_fp": "trunc(latency_multiplier * 100::FLOAT)::INT",
    "t_ms": "t",
    "remaining_ms": "total - t",
    "progress_pct": f"least(({_F32('t')}) / ({_F32('total')}) * 100::FLOAT, 100::FLOAT)",
    "rate_desc": f"CASE WHEN ramping THEN 'ramping to ' ELSE '' END || (bps // {O.MIB}) || ' MB/s'",
}


def _state_select(keys: str, columns: list[str]) -> str:
    return f"SELECT {keys}, " + ", ".join(f"{_STATE_SQL[c]} AS {c}" if c in _STATE_SQL else c for c in columns) + " FROM a"


def _with_fixed_point(df: DataFrame) -> DataFrame:
    error, latency = controller_fixed_point(F.col("effective_error"), F.col("latency_multiplier"))
    return df.withColumns({"clamped_fp": error, "latency_fp": latency})


def _register_states() -> None:
    for name, columns in _STATE_QUERIES.items():
        describe = "active_spikes" in columns

        def month_query(spark, d, columns=columns, describe=describe):
            return _with_fixed_point(month_rows(spark, d, describe)).select("event_id", *columns)

        def customer_query(spark, d, columns=columns, describe=describe):
            return _with_fixed_point(customer_rows(spark, d, describe)).select(*X.LINE_KEYS, *columns)

        query(f"{name}_month", O.month(_state_select("event_id", columns)))(month_query)
        query(name, O.customer(_state_select(O.LINE_KEYS, columns)))(customer_query)


_register_states()


# -- S19, R5, G4: budgets -------------------------------------------------------------------------
BUCKET = 1_000


def customer_budget(spark: SparkSession, d: str) -> DataFrame:
    return budget.row_budget(timeline_segments(X.short_control(spark, d)), BUCKET, longest_ms=X.SHORT_TOTAL)


def _area(a: str, b: str, dt: str) -> str:
    inside = f"least({dt}, rms)"
    bend = f"CASE WHEN rms > 0 THEN floor(({b} - {a})::DOUBLE * {inside}::DOUBLE * {inside}::DOUBLE / (2.0::DOUBLE * rms::DOUBLE))::BIGINT ELSE 0 END"
    return f"({a} * {inside} + {bend} + {b} * ({dt} - {inside}))"


# Each segment is cut by the buckets that it overlaps, and the pieces are summed.
BUDGET_CTES = f"""cells AS (SELECT seg.*, unnest(range(lo // {BUCKET}, (hi - 1) // {BUCKET} + 1)) AS bucket FROM seg),
    spans AS (SELECT *, greatest(lo, bucket * {BUCKET}) - lo AS p, least(hi, (bucket + 1) * {BUCKET}) - lo AS q FROM cells),
    per AS (SELECT sid, bucket, sum({_area('xl', 'yl', 'q')} - {_area('xl', 'yl', 'p')})::BIGINT AS log_ms,
        sum({_area('xb', 'yb', 'q')} - {_area('xb', 'yb', 'p')})::BIGINT AS byte_ms FROM spans GROUP BY ALL),
    cum AS MATERIALIZED (SELECT *, (sum(log_ms) OVER (PARTITION BY sid ORDER BY bucket))::BIGINT AS c, (sum(byte_ms) OVER (PARTITION BY sid ORDER BY bucket))::BIGINT AS b FROM per),
    budget AS MATERIALIZED (SELECT sid AS scenario_id, bucket, c // 1000 - (c - log_ms) // 1000 AS n_rows, b // 1000 - (b - byte_ms) // 1000 AS n_bytes FROM cum)"""
_BUDGET = f"WITH RECURSIVE {O.walk_ctes(O.SHORT_CONTROL, O.short_preset)}, {BUDGET_CTES}"


@query("s19_row_budget", f"{_BUDGET} SELECT * FROM budget")
def s19(spark, d):
    return customer_budget(spark, d)


@query(
    "r5_generated_rows",
    f"""{_BUDGET}, g AS (SELECT scenario_id, bucket, n_rows, unnest(range(n_rows)) AS i FROM budget WHERE n_rows > 0)
    SELECT scenario_id, bucket, i, bucket * {BUCKET} + i * {BUCKET} // n_rows AS t_ms,
        make_timestamp((epoch_ms(TIMESTAMP '{X.CUSTOMER_ORIGIN}') + bucket * {BUCKET} + i * {BUCKET} // n_rows) * 1000) AS ts FROM g""",
)
def r5(spark, d):
    rows = generate_rows(customer_budget(spark, d), BUCKET, X.CUSTOMER_ORIGIN)
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "g4_capacity_plan",
    f"""{_BUDGET}, s(fmt, line_bytes) AS (VALUES ('apache', 250), ('json', 350), ('syslog', 220))
    SELECT fmt, scenario_id, bucket // 12 AS hour, sum(n_rows)::BIGINT AS n_rows, sum(n_rows * line_bytes)::BIGINT AS n_bytes
    FROM budget CROSS JOIN s GROUP BY ROLLUP (fmt, scenario_id, bucket // 12)""",
)
def g4(spark, d):
    return budget.capacity_plan(customer_budget(spark, d), ["apache", "json", "syslog"], buckets_per_hour=12)


# -- S20, G1, G2 ----------------------------------------------------------------------------------
_INJECT = ["status", "duration_ms", "is_error", "is_unusual"]


def _inject_sql(control: str, rows: str, keys: str) -> str:
    attached = O.state_ctes(control, rows, keys)
    fields = O.field_ctes(f"SELECT {keys}, error_fp, spike_active, latency_multiplier, unusual, TIMESTAMP '2024-01-01' AS ts FROM a", keys,
                          rate="(error_fp::FLOAT / 10000::FLOAT)")
    slow = "CASE WHEN spike_active AND latency_multiplier > 0 THEN latency_multiplier::DOUBLE ELSE 1 END"
    return (
        f"WITH RECURSIVE {attached.replace('a0 AS', 'at0 AS').replace('FROM a0', 'FROM at0').replace('a0.*', 'at0.*')}, {fields} "
        f"SELECT {keys}, status, floor(duration_ms::DOUBLE * {slow})::BIGINT AS duration_ms, status >= 400 AS is_error, unusual AS is_unusual FROM f"
    )


@query("s20_inject_month", _inject_sql(O.MONTH_CONTROL, O.MONTH_ROWS, O.EVENT_KEYS))
def s20_month(spark, d):
    out = inject_anomalies(month_rows(spark, d), X.EVENT_KEYS, X.SEED, X.DIGEST, apply_latency=True)
    return out.select(*X.EVENT_KEYS, *_INJECT)


@query("s20_inject", _inject_sql(O.CUSTOMER_CONTROL, O.CUSTOMER_ROWS, O.LINE_KEYS))
def s20(spark, d):
    out = inject_anomalies(customer_rows(spark, d), X.LINE_KEYS, X.SEED, X.DIGEST, apply_latency=True)
    return out.select(*X.LINE_KEYS, *_INJECT)


_TRUTH = (
    "SELECT {keys}, t AS t_ms, spike_active AS is_anomaly, spike_error > base_error AS is_error_burst, "
    "latency_multiplier > 0 AS is_latency, unusual AS is_unusual FROM a"
)


@query("g1_ground_truth_month", O.month(_TRUTH.format(keys=O.EVENT_KEYS)))
def g1_month(spark, d):
    return audit.ground_truth(month_rows(spark, d), X.EVENT_KEYS)


@query("g1_ground_truth", O.customer(_TRUTH.format(keys=O.LINE_KEYS)))
def g1(spark, d):
    return audit.ground_truth(customer_rows(spark, d), X.LINE_KEYS)


TRUTH_BUCKET = 7 * X.DAY


@query(
    "g1_truth_buckets",
    f"""{_INSTANCES}, c AS (SELECT sid, greatest(s, 0) AS a, least(s + dur, total) AS b FROM inst JOIN meta USING (sid)), ok AS (SELECT * FROM c WHERE a < b),
    marks AS (SELECT *, max(b) OVER (PARTITION BY sid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
    isles AS (SELECT sid, min(a) AS a, max(b) AS b FROM (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isle FROM marks) GROUP BY sid, isle),
    cells AS (SELECT sid, unnest(range((total + {TRUTH_BUCKET - 1}) // {TRUTH_BUCKET})) AS bucket, total FROM meta),
    lim AS (SELECT sid, bucket, bucket * {TRUTH_BUCKET} AS lo, least((bucket + 1) * {TRUTH_BUCKET}, total) AS hi FROM cells),
    each AS (SELECT sid, bucket, sum(least(b, hi) - greatest(a, lo))::BIGINT AS ms, count(*) FILTER (a >= lo) AS started FROM lim JOIN ok USING (sid) WHERE a < hi AND b > lo GROUP BY ALL),
    any_ AS (SELECT sid, bucket, sum(least(b, hi) - greatest(a, lo))::BIGINT AS ms FROM lim JOIN isles USING (sid) WHERE a < hi AND b > lo GROUP BY ALL)
    SELECT sid AS scenario_id, bucket, coalesce(started, 0) AS started, coalesce(each.ms, 0) AS spike_ms, coalesce(any_.ms, 0) AS anomalous_ms, 2 * coalesce(any_.ms, 0) > hi - lo AS is_anomaly
    FROM lim LEFT JOIN each USING (sid, bucket) LEFT JOIN any_ USING (sid, bucket)""",
)
def g1_buckets(spark, d):
    return audit.truth_buckets(instances(spark, d), X.customer_control(spark, d).meta, TRUTH_BUCKET, longest_ms=X.CUSTOMER_TOTAL)


ALERT_BUCKET = 6 * X.HOUR
# A six-hour bucket alerts when more than a quarter of its events are errors.
_ALERTS = f"SELECT t // {ALERT_BUCKET} AS bucket, 4 * count(*) FILTER (event_type = 'error') > count(*) AS alert, 2 * count(*) FILTER (spike_active) > count(*) AS anomalous FROM a GROUP BY 1"


def _alert_buckets(spark: SparkSession, d: str) -> DataFrame:
    error = F.sum((F.col("event_type") == "error").cast("bigint"))
    return month_rows(spark, d).groupBy(F.floor(F.col("t_ms") / F.lit(ALERT_BUCKET)).alias("bucket")).agg(
        (error * 4 > F.count("*")).alias("alert"),
        (F.sum(F.col("spike_active").cast("bigint")) * 2 > F.count("*")).alias("anomalous"),
    )


@query(
    "g2_alert_score",
    O.month(
        f""", b AS ({_ALERTS}), n AS (SELECT count(*) FILTER (alert AND anomalous) AS tp, count(*) FILTER (alert AND NOT anomalous) AS fp,
        count(*) FILTER (NOT alert AND anomalous) AS fn, count(*) FILTER (NOT alert AND NOT anomalous) AS tn FROM b)
        SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall FROM n"""
    ),
)
def g2_score(spark, d):
    buckets = _alert_buckets(spark, d)
    return audit.score_alerts(buckets.select("bucket", "alert"), buckets.select("bucket", "anomalous"))


DELAY_BUCKET = 10 * X.DAY


@query(
    "g2_detection_delay",
    O.customer(
        f""", al AS (SELECT sid, t // {DELAY_BUCKET} AS bucket FROM a GROUP BY ALL HAVING count(*) >= 2),
        hits AS (SELECT inst.sid, idx, rep, min(bucket) AS b FROM inst JOIN al ON al.sid = inst.sid
            AND bucket >= floor(s::DOUBLE / {DELAY_BUCKET}) AND bucket <= floor((s + dur - 1)::DOUBLE / {DELAY_BUCKET}) GROUP BY ALL)
        SELECT inst.sid AS scenario_id, inst.idx AS spike_idx, inst.rep, type, s AS start_ms, b AS first_bucket, b IS NOT NULL AS detected,
            CASE WHEN b IS NOT NULL THEN greatest(b * {DELAY_BUCKET} - s, 0) END AS delay_ms
        FROM inst LEFT JOIN hits ON hits.sid = inst.sid AND hits.idx = inst.idx AND hits.rep = inst.rep"""
    ),
)
def g2_delay(spark, d):
    busy = customer_rows(spark, d).groupBy(F.col("custkey").cast("string").alias("scenario_id"), F.floor(F.col("t_ms") / F.lit(DELAY_BUCKET)).alias("bucket")).agg(F.count("*").alias("n"))
    out = audit.detection_delay(busy.filter("n >= 2"), instances(spark, d), DELAY_BUCKET)
    return out.withColumn("delay_ms", F.when(F.col("detected"), F.col("delay_ms")))


# -- R2, R3, R4 -----------------------------------------------------------------------------------
def request_texts(spark: SparkSession, d: str) -> DataFrame:
    key, pr = F.col("o_orderkey"), F.col("o_orderpriority")
    url = F.concat(F.lit('{"output":"https://sink.invalid/'), F.col("o_custkey"), F.lit('","duration":"'), key % 50 + 1, F.lit('m"'))
    inline = '[scenario]\\nname = \\"inline\\"\\ntotal_duration = \\"3m\\"\\n[[timeline]]\\nat = \\"0s\\"\\n'
    text = _text(
        key % 17,
        F.concat(url, F.lit("}")),
        F.concat(url, F.lit(',"format":"json","rate":"high","http_batch_kb":'), key % 64 + 1, F.lit("}")),
        F.concat(url, F.lit(',"format":"syslog","rate":{"throughput_mb":'), key % 40 + 1, F.lit(',"logs_per_sec":'), key, F.lit("}}")),
        F.concat(url, F.lit(',"http_auth":"Basic '), pr, F.lit('","http_headers":[{"name":"X-A","value":"1"},{"name":"X-B","value":"2"}],"http_timeout":5,"http_senders":2}')),
        F.concat(url, F.lit(',"format":"'), pr, F.lit('"}')),
        F.lit('{"output":"https://sink.invalid/x","duration":"500ms"}'),
        F.concat(F.lit('{"output":"ftp://sink.invalid/'), key, F.lit('","duration":"1h"}')),
        F.concat(F.lit('{"output":"https://sink.invalid/'), key),
        F.lit('{"duration":"1h"}'),
        F.concat(url, F.lit(',"format":"nginx","rate":"ramp_to_full","threads":4}')),
        F.concat(url, F.lit(',"rate":'), key, F.lit("}")),
        F.concat(url, F.lit(',"rate":{"throughput_mb":3}}')),
        F.concat(url, F.lit(',"http_batch_kb":-'), key, F.lit("}")),
        F.concat(url, F.lit(',"http_headers":[{"name":"X-A","value":"1"},{"name":"X-B"}]}')),
        F.lit('{"output":"https://sink.invalid/x","duration":90}'),
        F.concat(url, F.lit(f',"format":"json","rate":"low","scenario_toml":"{inline}rate = \\"high\\"\\n"}}')),
        F.concat(url, F.lit(f',"scenario_toml":"{inline}"}}')),
    )
    return X.table(spark, d, "orders").select(key.alias("request_id"), text.alias("json"))


_REQUESTS = """t AS (SELECT o_orderkey AS request_id, '{"output":"https://sink.invalid/' || o_custkey || '","duration":"' || (o_orderkey % 50 + 1) || 'm"' AS url, * FROM orders),
    req AS (SELECT request_id, CASE o_orderkey % 17 WHEN 0 THEN url || '}'
      WHEN 1 THEN url || ',"format":"json","rate":"high","http_batch_kb":' || (o_orderkey % 64 + 1) || '}'
      WHEN 2 THEN url || ',"format":"syslog","rate":{"throughput_mb":' || (o_orderkey % 40 + 1) || ',"logs_per_sec":' || o_orderkey || '}}'
      WHEN 3 THEN url || ',"http_auth":"Basic ' || o_orderpriority || '","http_headers":[{"name":"X-A","value":"1"},{"name":"X-B","value":"2"}],"http_timeout":5,"http_senders":2}'
      WHEN 4 THEN url || ',"format":"' || o_orderpriority || '"}' WHEN 5 THEN '{"output":"https://sink.invalid/x","duration":"500ms"}'
      WHEN 6 THEN '{"output":"ftp://sink.invalid/' || o_orderkey || '","duration":"1h"}' WHEN 7 THEN '{"output":"https://sink.invalid/' || o_orderkey
      WHEN 8 THEN '{"duration":"1h"}' WHEN 9 THEN url || ',"format":"nginx","rate":"ramp_to_full","threads":4}'
      WHEN 10 THEN url || ',"rate":' || o_orderkey || '}' WHEN 11 THEN url || ',"rate":{"throughput_mb":3}}' WHEN 12 THEN url || ',"http_batch_kb":-' || o_orderkey || '}'
      WHEN 13 THEN url || ',"http_headers":[{"name":"X-A","value":"1"},{"name":"X-B"}]}' WHEN 14 THEN '{"output":"https://sink.invalid/x","duration":90}'
      WHEN 15 THEN url || ',"format":"json","rate":"low","scenario_toml":"' || doc || 'rate = \\"high\\"\\n"}' ELSE url || ',"scenario_toml":"' || doc || '"}' END AS json
      FROM (SELECT *, '[scenario]\\nname = \\"inline\\"\\ntotal_duration = \\"3m\\"\\n[[timeline]]\\nat = \\"0s\\"\\n' AS doc FROM t)),
    j AS (SELECT request_id, json, json_valid(json) AS valid, CASE WHEN json_valid(json) THEN json::JSON END AS x FROM req),
    chk AS (SELECT *, CASE WHEN NOT valid THEN 'invalid JSON' WHEN x->>'output' IS NULL THEN 'invalid JSON: missing field output'
        WHEN json_type(x->'duration') <> 'VARCHAR' THEN 'invalid JSON: wrong type: duration'
        WHEN json_type(x->'rate') NOT IN ('VARCHAR', 'OBJECT') THEN 'invalid JSON: wrong type: rate'
        WHEN json_type(x->'rate') = 'OBJECT' AND (x->'rate'->>'logs_per_sec') IS NULL THEN 'invalid JSON: wrong type: rate lacks logs_per_sec'
        WHEN (x->>'http_batch_kb')::BIGINT < 0 THEN 'invalid JSON: wrong type: http_batch_kb'
        WHEN (x->'http_headers') IS NOT NULL AND (x->'http_headers'->1->>'value') IS NULL THEN 'invalid JSON: wrong type: http_headers[1] lacks value'
        WHEN (x->>'scenario_toml') IS NOT NULL AND NOT contains(x->>'scenario_toml', 'rate') THEN 'invalid scenario document: missing rate in timeline'
        WHEN NOT regexp_full_match(x->>'duration', '([0-9]+[hms])*([0-9]+)?') THEN 'invalid duration ''' || (x->>'duration') || ''''
        WHEN coalesce(x->>'format', 'event') NOT IN ('apache', 'nginx', 'json', 'syslog', 'event') THEN 'unknown format ''' || (x->>'format') || ''''
        WHEN NOT regexp_matches(x->>'output', '^https?://') THEN 'output must be an HTTP URL, got ''' || (x->>'output') || '''' END AS error FROM j)"""


@query("r3_validate_requests", f"WITH {_REQUESTS} SELECT request_id, json, error FROM chk")
def r3(spark, d):
    return validate_requests(request_texts(spark, d), "json")


@query(
    "r2_expand_requests",
    f"""WITH {_REQUESTS}
    SELECT request_id::VARCHAR AS scenario_id, CASE WHEN (x->>'scenario_toml') IS NULL THEN 'remote' ELSE 'inline' END AS name,
        CASE WHEN (x->>'scenario_toml') IS NULL THEN regexp_extract(x->>'duration', '([0-9]+)m', 1)::BIGINT ELSE 3 END * 60000 AS total_ms,
        CASE WHEN (x->>'scenario_toml') IS NOT NULL THEN 'high' WHEN json_type(x->'rate') IS DISTINCT FROM 'OBJECT' THEN coalesce(x->>'rate', 'low') END AS rate_name,
        (x->'rate'->>'logs_per_sec')::BIGINT AS lps, (x->'rate'->>'throughput_mb')::INT AS mb, x->>'output' AS url, coalesce(x->>'format', 'event') AS format,
        coalesce((x->>'http_batch_kb')::BIGINT, 1024) * 1024 AS batch_bytes, coalesce((x->>'http_timeout')::BIGINT, 30) AS timeout_s,
        coalesce((x->>'http_senders')::BIGINT, 8) AS senders, x->>'http_auth' AS auth, coalesce(json_array_length(x->'http_headers'), 0)::INT AS n_headers
    FROM chk WHERE error IS NULL""",
)
def r2(spark, d):
    got = expand_requests(request_texts(spark, d), "json", "request_id")
    control = got["control"]
    meta = control.meta.select("scenario_id", "name", "total_ms")
    timeline = control.timeline.select("scenario_id", "rate_name", "lps", "mb")
    outputs = got["outputs"].select("scenario_id", "url", "format", "batch_bytes", "timeout_s", "senders", "auth", "n_headers")
    return meta.join(timeline, "scenario_id").join(outputs, "scenario_id")


@query(
    "r4_override",
    f"""WITH {O.CUSTOMER_CONTROL}, {O.spike_ctes()}
    SELECT sid AS scenario_id, CASE WHEN sid::BIGINT % 3 = 0 THEN 'full' END AS rate_name,
        CASE WHEN sid::BIGINT % 3 <> 0 THEN sid::BIGINT * 1000 END AS lps, CASE WHEN sid::BIGINT % 3 <> 0 THEN ceil(sid::BIGINT * 1000 * 200::DOUBLE / 1048576)::INT END AS mb,
        'json' AS format, (SELECT count(*) FROM sp WHERE sp.sid = meta.sid) AS n_spikes FROM meta""",
)
def r4(spark, d):
    control = X.customer_control(spark, d)
    rate = F.when(F.col("scenario_id").cast("bigint") % 3 == 0, "full").otherwise(F.concat(F.col("scenario_id"), F.lit("K")))
    out = override_scenario(control, rate, "json")
    spikes = out.spikes.groupBy("scenario_id").agg(F.count("*").alias("n_spikes"))
    events = out.timeline.select("scenario_id", "rate_name", "lps", "mb")
    rows = out.meta.select("scenario_id", "format").join(events, "scenario_id").join(spikes, "scenario_id", "left")
    return rows.withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)))


# -- S18 beyond the broadcast size ----------------------------------------------------------------
@query("s18_attach_merge", O.customer(_state_select(O.LINE_KEYS, _STATE_QUERIES["s18_attach"])))
def s18_merge(spark, d):
    """The merge of rows and interval starts, whatever their number."""
    states = States(X.customer_states(spark, d).intervals, literal_rows=0, broadcast_rows=0)
    return attach_scenario(X.customer_rows(spark, d), states, "l_shipdate", X.CUSTOMER_ORIGIN, "custkey").select(*X.LINE_KEYS, *_STATE_QUERIES["s18_attach"])
