"""SQL building blocks for the cross-check queries (DuckDB dialect).

These spell the semantics out independently of the DataFrame code: explicit
slot bounds instead of weight tables, a recursive walk over timeline events
instead of window scans, and direct interval joins instead of atomic intervals.
"""

from __future__ import annotations

from ..functions import vocab as V
from . import fixtures as X

SEED = X.SEED
MIB = 1048576


def q(text: object) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def digest(stream: str, number: int, keys: str, seed: int = SEED) -> str:
    return f"md5(concat_ws('|', '{seed}', '{stream}', '{number}', {keys}))"


def cut(column: str, word: int, offset: int, width: int) -> str:
    """Unsigned slice of a digest column that holds words 2n and 2n+1."""
    return f"('0x' || {hexcut(column, word, offset, width)})::BIGINT"


def hexcut(column: str, word: int, offset: int, width: int) -> str:
    return f"substr({column}, {1 + 16 * (word % 2) + offset // 4}, {width // 4})"


def lookup(values: list, index: str) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + f"][({index}) + 1]"


def bounds(slot: str, runs: list[tuple[int, object]], rest: object) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {slot} < {hi} THEN {lit(v)}" for hi, v in runs) + f" ELSE {lit(rest)} END"


# Slot bounds (cumulative, of 256), with the owner of the left-over slots last.
SUCCESS = ([(179, 200), (191, 201), (203, 204), (208, 206), (215, 301), (222, 302), (247, 304), (252, 307)], 200)
CLIENT = ([(51, 400), (115, 401), (153, 403), (229, 404), (236, 405), (241, 408), (246, 409), (251, 422), (253, 429)], 400)
SERVER = ([(128, 500), (179, 502), (230, 503), (255, 504)], 500)
METHOD = ([(153, "GET"), (204, "POST"), (224, "PUT"), (236, "DELETE"), (246, "PATCH"), (251, "HEAD"), (253, "OPTIONS")], "GET")
LEVEL = ([(12, "DEBUG"), (191, "INFO"), (229, "WARN"), (249, "ERROR"), (254, "FATAL")], "INFO")


def field_ctes(source: str, keys: str, ts: str = "ts", rate: str = "0.01::FLOAT") -> str:
    """CTEs ending in ``f``: the source rows with every log field."""
    w = lambda word, off, width: cut(f"h{word // 2}", word, off, width)
    unit = lambda word, off: f"({w(word, off, 24)}::DOUBLE / 16777216)::FLOAT"
    rng = lambda draw, lo, hi: f"({lo} + {draw} % {hi - lo + 1})"
    size = w(2, 16, 32)
    octet = lambda off: f"({cut('i0', 0, off, 8)})"
    last = f"({cut('i0', 0, 48, 16)} % 254 + 1)"
    first_n = f"({cut('i0', 1, 0, 32)} % 221 + 1)"
    first = f"(CASE WHEN {first_n} <= 9 THEN {first_n} WHEN {first_n} <= 125 THEN {first_n} + 1 ELSE {first_n} + 2 END)"
    kind = lambda col: cut(col, 0, 0, 32) + " % 100"
    prefix_no = cut("p0", 0, 32, 8)
    segment = lookup(V.PATH_SEGMENTS, f"{cut('p0', 0, 40, 16)} % {len(V.PATH_SEGMENTS)}")
    page = f"({lookup(V.PATH_PREFIXES, prefix_no + ' % 16')} || '/' || {segment})"
    uuid = (
        f"({hexcut('p1', 2, 0, 32)} || '-' || {hexcut('p1', 2, 32, 16)} || '-' || {hexcut('p1', 2, 48, 16)} || '-' || "
        f"{hexcut('p1', 3, 0, 16)} || '-' || {hexcut('p1', 3, 16, 48)})"
    )
    path = f"""CASE WHEN {kind('p0')} < 40 THEN {page} || CASE WHEN {cut('p0', 0, 56, 8)} >= 128
          THEN '/' || ({cut('p0', 1, 0, 32)} % 99999 + 1) ELSE '' END
        WHEN {kind('p0')} < 60 THEN '/static/' || {hexcut('p0', 1, 32, 32)} || {lookup(V.PATH_EXTENSIONS, cut('p2', 4, 0, 16) + ' % 10')}
        WHEN {kind('p0')} < 75 THEN '/api/v1/' || {lookup(V.PATH_RESOURCES, cut('p2', 4, 16, 16) + ' % 4')} || '/' || {uuid}
        WHEN {kind('p0')} < 90 THEN {lookup(V.PATH_PREFIXES, prefix_no + ' % 8')} || '/' || {segment} || '?page=' ||
          ({cut('p2', 4, 32, 16)} % 99 + 1) || '&limit=' || {lookup(V.PAGE_LIMITS, cut('p2', 4, 48, 8) + ' % 5')}
        ELSE {lookup(V.SIMPLE_PATHS, cut('p2', 4, 56, 8) + ' % 8')} END"""
    families = [agents for _, agents in V.USER_AGENT_FAMILIES]
    ua_draw = cut("a0", 0, 32, 32)
    agent = "CASE " + " ".join(
        f"WHEN {kind('a0')} < {hi} THEN {lookup(family, f'{ua_draw} % {len(family)}')}"
        for hi, family in zip((50, 65, 75, 90, 95, 100), families, strict=True)
    ) + " END"
    message = "CASE " + " ".join(
        f"WHEN status IN ({', '.join(map(str, codes))}) THEN {q(text)}" for codes, text in V.STATUS_MESSAGES
    ) + f" ELSE {q(V.DEFAULT_STATUS_MESSAGE)} END"
    return f"""
    src AS ({source}),
    h AS (SELECT *, {rate} AS rate_, {ts} AS ts_, {', '.join(f"{digest('row', i, keys)} AS h{i}" for i in range(5))} FROM src),
    pools AS (SELECT *, {digest('ip', 0, w(0, 0, 16))} AS i0, {', '.join(f"{digest('path', i, w(0, 16, 16) + ' % 4096')} AS p{i}" for i in range(3))},
        {digest('agent', 0, w(0, 32, 8))} AS a0 FROM h),
    st AS (SELECT *, (CASE WHEN {unit(1, 32)} < rate_ THEN CASE WHEN {w(1, 56, 8)} >= 128 THEN {bounds(w(2, 0, 8), *CLIENT)}
        ELSE {bounds(w(2, 0, 8), *SERVER)} END ELSE {bounds(w(2, 0, 8), *SUCCESS)} END)::INT AS status,
        {bounds(w(1, 24, 8), *LEVEL)} AS drawn_level FROM pools),
    f AS (SELECT *,
        CASE WHEN {kind('i0')} < 30 THEN '10.' || {octet(32)} || '.' || {octet(40)} || '.' || {last}
             WHEN {kind('i0')} < 50 THEN '192.168.' || {octet(40)} || '.' || {last}
             WHEN {kind('i0')} < 60 THEN '172.' || (16 + {cut('i0', 1, 32, 8)} % 16) || '.' || {octet(40)} || '.' || {last}
             ELSE {first} || '.' || {octet(32)} || '.' || {octet(40)} || '.' || {last} END AS ip,
        CASE WHEN {w(1, 0, 8)} % 64 < 32 THEN '-' ELSE {lookup(V.USERNAMES, w(1, 0, 8) + ' % 64 - 32')} END AS username,
        {bounds(w(0, 40, 8), *METHOD)} AS method,
        {path} AS path,
        {lookup(['HTTP/1.0', 'HTTP/1.1', 'HTTP/1.1', 'HTTP/2.0'], w(0, 48, 8) + ' % 4')} AS protocol,
        (CASE WHEN status = 204 THEN 0
              WHEN status IN (200, 201) THEN CASE WHEN {w(2, 8, 8)} < 100 THEN {rng(size, 50, 500)} WHEN {w(2, 8, 8)} < 200 THEN {rng(size, 500, 5000)} ELSE {rng(size, 5000, 50000)} END
              WHEN status IN (301, 302, 304, 307) THEN {rng(size, 50, 500)}
              WHEN status >= 400 THEN {rng(size, 100, 1000)} ELSE {rng(size, 500, 5000)} END)::BIGINT AS body_bytes,
        CASE WHEN {w(0, 56, 8)} < 154 THEN '-' ELSE {lookup(V.REFERRERS, f"({w(0, 56, 8)} - 154) % 7")} END AS referrer,
        {agent} AS user_agent,
        CASE WHEN status >= 500 THEN 0.5::FLOAT + {unit(8, 0)} * 4.5::FLOAT WHEN status >= 400 THEN 0.01::FLOAT + {unit(8, 0)} * 0.5::FLOAT
             ELSE 0.001::FLOAT + {unit(8, 0)} * 0.2::FLOAT END AS request_time,
        CASE WHEN status >= 500 THEN 'ERROR' WHEN status >= 400 THEN 'WARN' ELSE drawn_level END AS level,
        {lookup(V.SERVICES, w(1, 8, 8) + ' % 8')} AS service,
        {lookup(V.HOSTS, w(1, 16, 8) + ' % 8')} AS host,
        {hexcut('h2', 4, 0, 64)} AS trace_id,
        {hexcut('h2', 5, 0, 32)} AS span_id,
        {hexcut('h3', 6, 0, 64)} AS request_id,
        'MSG' || upper({hexcut('h2', 5, 32, 32)}) AS msg_id,
        (1000 + {w(7, 0, 32)} % 50000)::INT AS pid,
        (CASE WHEN status >= 500 THEN 100 + {w(3, 0, 32)} % 5000 WHEN status >= 400 THEN 10 + {w(3, 0, 32)} % 500 ELSE 1 + {w(3, 0, 32)} % 200 END)::INT AS duration_ms,
        (100 + {w(3, 32, 32)} % 10000)::INT AS request_size,
        {message} AS message,
        CASE WHEN {unit(8, 24)} < rate_ THEN CASE WHEN {w(8, 48, 8)} >= 128 THEN 'ERROR' ELSE 'WARN' END ELSE drawn_level END AS syslog_level,
        (1 + {w(7, 32, 32)} % 999)::INT AS syslog_duration_ms,
        epoch_us(ts_) // 1000000 - {w(2, 48, 8)} % 2 AS event_epoch
        FROM st)"""


APACHE_TS = "'[' || strftime(ts_, '%d/%b/%Y:%H:%M:%S') || ' +0000]'"
COMBINED = (
    f"(ip || ' - ' || username || ' ' || {APACHE_TS} || ' \"' || method || ' ' || path || ' ' || protocol || '\" ' || status || ' ' "
    "|| body_bytes || ' \"' || referrer || '\" \"' || user_agent || '\"')"
)


def float_text(x: str) -> str:
    """The shortest decimal text that reads back as the same FLOAT (values from 0.001 on)."""
    tries = " ".join(f"WHEN printf('%.{n}g', {x}::DOUBLE)::FLOAT = {x} THEN printf('%.{n}g', {x}::DOUBLE)" for n in range(1, 9))
    shortest = f"(CASE {tries} ELSE printf('%.9g', {x}::DOUBLE) END)"
    return f"(CASE WHEN contains({shortest}, '.') THEN {shortest} ELSE {shortest} || '.0' END)"


NGINX_LINE = f"({COMBINED} || ' ' || {float_text('request_time')})"
JSON_LINE = (
    "('{\"timestamp\":\"' || strftime(ts_, '%Y-%m-%dT%H:%M:%S.%gZ') || '\",\"level\":\"' || level || '\",\"service\":\"' || service "
    "|| '\",\"trace_id\":\"' || trace_id || '\",\"span_id\":\"' || span_id || '\",\"message\":\"' || message || '\",\"method\":\"' || method "
    "|| '\",\"path\":\"' || path || '\",\"status\":' || status || ',\"duration_ms\":' || duration_ms || ',\"client_ip\":\"' || ip || '\"}')"
)
LEVEL_TEXT = (
    "CASE syslog_level WHEN 'DEBUG' THEN 'Debug checkpoint reached' WHEN 'INFO' THEN 'Operation completed successfully' "
    "WHEN 'WARN' THEN 'Potential issue detected' WHEN 'ERROR' THEN 'Error occurred during processing' "
    "WHEN 'FATAL' THEN 'Critical failure, service impacted' ELSE 'Log event recorded' END"
)
PRI = "CASE syslog_level WHEN 'DEBUG' THEN 135 WHEN 'WARN' THEN 132 WHEN 'ERROR' THEN 131 WHEN 'FATAL' THEN 130 ELSE 134 END"
SYSLOG_LINE = (
    f"('<' || {PRI} || '>1 ' || strftime(ts_, '%Y-%m-%dT%H:%M:%S.%f+00:00') || ' ' || host || ' ' || service || ' ' || pid || ' ' || msg_id "
    "|| ' [meta request_id=\"' || request_id || '\" duration_ms=\"' || syslog_duration_ms || '\" level=\"' || syslog_level || '\"] ' || "
    f"{LEVEL_TEXT})"
)
EVENT_LEVEL = "CASE WHEN status >= 500 THEN 'error' WHEN status >= 400 THEN 'warn' ELSE 'info' END"
EVENT_LINE = (
    "('{\"timestamp\":' || event_epoch || ',\"tags\":{\"service\":\"' || service || '\",\"host\":\"' || host || '\",\"level\":\"' || "
    f"{EVENT_LEVEL} || '\",\"method\":\"' || method || '\",\"path\":\"' || path || '\",\"status\":\"' || status "
    "|| '\"},\"metrics\":{\"response_time_ms\":' || duration_ms || ',\"request_count\":1,\"request_size\":' || request_size "
    "|| ',\"response_size\":' || body_bytes || '}}')"
)


# -- scenarios -------------------------------------------------------------------------------
def _values(rows: list[tuple], columns: list[tuple[str, str]]) -> str:
    lit = lambda v: "NULL" if v is None else (q(v) if isinstance(v, str) else str(v))
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    names = ", ".join(n for n, _ in columns)
    cast = ", ".join(f"{n}::{t} AS {n}" for n, t in columns)
    return f"SELECT 'month' AS sid, {cast} FROM (VALUES {body}) AS v({names})"


MONTH_CONTROL = f"""
    meta AS (SELECT 'month' AS sid, {X.MONTH_TOTAL} AS total),
    tl AS ({_values(X.MONTH_TIMELINE, [('idx', 'BIGINT'), ('at_ms', 'BIGINT'), ('rate', 'VARCHAR'), ('lps', 'BIGINT'), ('mb', 'BIGINT'), ('ramp', 'BIGINT'), ('err', 'FLOAT')])}),
    sp AS ({_values(X.MONTH_SPIKES, [('idx', 'BIGINT'), ('at_ms', 'BIGINT'), ('type', 'VARCHAR'), ('dur', 'BIGINT'), ('elo', 'FLOAT'), ('ehi', 'FLOAT'), ('lat', 'FLOAT'), ('cnt', 'BIGINT'), ('gap', 'BIGINT'), ('jit', 'BIGINT')])})"""

CUSTOMER_CONTROL = f"""
    o AS (SELECT *, o_custkey::VARCHAR AS sid, epoch_us(o_orderdate) // 1000 - epoch_ms(TIMESTAMP '{X.CUSTOMER_ORIGIN}') AS at_ms FROM orders),
    meta AS (SELECT DISTINCT sid, {X.CUSTOMER_TOTAL} AS total FROM o),
    tl AS (SELECT sid, o_orderkey AS idx, at_ms,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 'full' WHEN '2' THEN 'high' WHEN '3' THEN 'ramp_to_full' WHEN '4' THEN 'unknown' ELSE 'ramp_to_low' END AS rate,
        NULL::BIGINT AS lps, NULL::BIGINT AS mb, CASE left(o_orderpriority, 1) WHEN '3' THEN {30 * X.DAY} END AS ramp,
        CASE WHEN o_orderkey % 4 <> 0 THEN ((o_orderkey % 100)::DOUBLE / 10)::FLOAT END AS err
        FROM o WHERE o_orderkey % 3 <> 0),
    sp AS (SELECT sid, o_orderkey AS idx, at_ms,
        CASE (o_orderkey // 3) % 4 WHEN 0 THEN 'error_burst' WHEN 1 THEN 'latency_spike' WHEN 2 THEN 'unusual_patterns' ELSE 'mixed' END AS type,
        (20 + o_orderkey % 181) * {X.DAY} AS dur,
        CASE o_orderstatus WHEN 'F' THEN 20 WHEN 'P' THEN 50 END::FLOAT AS elo, CASE o_orderstatus WHEN 'F' THEN 80 WHEN 'P' THEN 50 END::FLOAT AS ehi,
        CASE WHEN o_orderkey % 5 <> 0 THEN 1 + o_orderkey % 10 END::FLOAT AS lat,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 4 END AS cnt, {60 * X.DAY} AS gap, {5 * X.DAY} AS jit
        FROM o WHERE o_orderkey % 3 = 0)"""


# The same scripts on a short clock, a day in SHORT_DAY milliseconds, with small rates of the customers' own.
SHORT_CONTROL = (
    CUSTOMER_CONTROL.replace(f"SELECT DISTINCT sid, {X.CUSTOMER_TOTAL} AS total", f"SELECT DISTINCT sid, {X.SHORT_TOTAL} AS total")
    .replace("SELECT sid, o_orderkey AS idx, at_ms,", f"SELECT sid, o_orderkey AS idx, at_ms // {X.DAY} * {X.SHORT_DAY} AS at_ms,")
    .replace(f"WHEN '3' THEN {30 * X.DAY} END AS ramp", f"WHEN '3' THEN {30 * X.SHORT_DAY} END AS ramp")
    .replace(f"* {X.DAY} AS dur", f"* {X.SHORT_DAY} AS dur").replace(f"{60 * X.DAY} AS gap, {5 * X.DAY} AS jit", f"{60 * X.SHORT_DAY} AS gap, {5 * X.SHORT_DAY} AS jit")
)


def short_preset(name: str, what: str) -> str:
    c = "sid::BIGINT"
    rates = {"lps": (f"1 + {c} % 3", f"5 + {c} % 4", "4", "2"), "mb": ("1", "3", f"1 + {c} % 2", "2")}[what]
    return f"CASE {name} WHEN 'low' THEN {rates[0]} WHEN 'full' THEN {rates[1]} WHEN 'high' THEN {rates[2]} ELSE {rates[3]} END"


def secs(ms: str) -> str:
    return f"(({ms}) // 1000 + (({ms}) % 1000 * 1000000)::DOUBLE / 1e9)"


def lerp(a: str, b: str, p: str) -> str:
    return f"({a} + sign({b} - {a})::BIGINT * trunc(abs({b} - {a})::DOUBLE * {p})::BIGINT)"


def at(a: str, b: str, lo: str, ramp: str, t: str) -> str:
    """Value of a ramp at t (flat when ramp is 0)."""
    return f"CASE WHEN {t} - {lo} >= {ramp} THEN {b} ELSE {lerp(a, b, f'({secs(f'{t} - {lo}')} / {secs(ramp)})')} END"


def _preset(name: str, what: str) -> str:
    table = {"mb": {n: m for n, m, _ in V.RATE_PRESETS}, "lps": {n: p for n, _, p in V.RATE_PRESETS}}[what]
    return "CASE " + name + " " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in table.items()) + f" ELSE {table['medium']} END"


def walk_ctes(control: str, preset=_preset) -> str:
    """Segments by walking the events of each scenario one by one (needs WITH RECURSIVE); ``preset`` gives a name's rate."""
    cur = lambda a, b: f"CASE WHEN w.eff2 = w.lo AND w.ramp THEN w.{a} ELSE {at(f'w.{a}', f'w.{b}', 'w.lo', 'w.rms', 'w.eff2')} END"
    return f"""{control},
    ev AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY idx) AS n, at_ms, coalesce(starts_with(rate, 'ramp_to_'), false) AS is_ramp,
        CASE WHEN rate IS NULL THEN lps ELSE {preset("replace(rate, 'ramp_to_', '')", 'lps')} END AS t_lps,
        (CASE WHEN rate IS NULL THEN mb ELSE {preset("replace(rate, 'ramp_to_', '')", 'mb')} END) * {MIB} AS t_bps,
        coalesce(ramp, 30000) AS rms, (err / 100::FLOAT)::FLOAT AS err FROM tl),
    walk AS (
        SELECT sid, 0::BIGINT AS n, 0::BIGINT AS eff, false AS ramp, 0::BIGINT AS lo, 0::BIGINT AS rms, ({preset("'low'", 'lps')})::BIGINT AS xl, ({preset("'low'", 'lps')})::BIGINT AS yl,
            ({preset("'low'", 'mb')})::BIGINT * {MIB} AS xb, ({preset("'low'", 'mb')})::BIGINT * {MIB} AS yb, 0.01::FLOAT AS err FROM meta
        UNION ALL
        SELECT w.sid, e.n, w.eff2, e.is_ramp, w.eff2, CASE WHEN e.is_ramp THEN e.rms ELSE 0 END,
            CASE WHEN e.is_ramp THEN {cur('xl', 'yl')} ELSE e.t_lps END, e.t_lps,
            CASE WHEN e.is_ramp THEN {cur('xb', 'yb')} ELSE e.t_bps END, e.t_bps, coalesce(e.err, w.err)
        FROM (SELECT walk.*, greatest(walk.eff, ev.at_ms) AS eff2 FROM walk JOIN ev ON ev.sid = walk.sid AND ev.n = walk.n + 1) w
        JOIN ev e ON e.sid = w.sid AND e.n = w.n + 1),
    steps AS (SELECT walk.*, total FROM walk JOIN meta USING (sid) WHERE eff < total
        QUALIFY row_number() OVER (PARTITION BY walk.sid, eff ORDER BY n DESC) = 1),
    seg AS (SELECT sid, eff AS lo, coalesce(lead(eff) OVER (PARTITION BY sid ORDER BY eff), total) AS hi, total, xl, yl, xb, yb, rms, err FROM steps)"""


def spike_ctes() -> str:
    keys = "sid, idx, rep"
    wide = f"({cut('d0', 0, 0, 32)} * 268435456 + {cut('d0', 0, 32, 28)})"
    unit = f"({cut('d0', 1, 0, 24)}::DOUBLE / 16777216)::FLOAT"
    return f"""
    reps AS (SELECT sp.*, unnest(range(coalesce(cnt, 1))) AS rep FROM sp),
    draws AS (SELECT *, {digest('spike', 0, keys)} AS d0 FROM reps),
    inst AS (SELECT sid, idx, rep, type, at_ms + rep * coalesce(gap, 0) + CASE WHEN cnt IS NOT NULL AND coalesce(jit, 0) > 0 THEN {wide} % (2 * jit + 1) - jit ELSE 0 END AS s,
        dur, coalesce(((elo + {unit} * (ehi - elo)) / 100::FLOAT)::FLOAT, 0.5::FLOAT) AS error, coalesce(lat, 1::FLOAT) AS latency FROM draws)"""


def state_ctes(control: str, rows: str, keys: str, preset=_preset) -> str:
    """CTEs ending in ``a``: rows (with sid and t) inside the clock with their state by direct interval joins."""
    return f"""{walk_ctes(control, preset)}, {spike_ctes()},
    r AS ({rows}),
    hit AS (SELECT {keys}, count(*) AS n_active,
        greatest(0::FLOAT, max(CASE WHEN type IN ('error_burst', 'mixed') THEN error END)) AS spike_error,
        greatest(0::FLOAT, max(CASE WHEN type IN ('latency_spike', 'mixed') THEN latency END)) AS latency_multiplier,
        bool_or(type = 'unusual_patterns') AS unusual,
        string_agg(CASE type WHEN 'error_burst' THEN 'ErrorBurst' WHEN 'latency_spike' THEN 'LatencySpike' WHEN 'unusual_patterns' THEN 'UnusualPatterns' ELSE 'Mixed' END,
            ', ' ORDER BY s, idx, rep) AS active_spikes
        FROM r JOIN inst USING (sid) WHERE t >= s AND t < s + dur GROUP BY ALL),
    a0 AS (SELECT r.*, seg.lo AS seg_lo, total, {at('xl', 'yl', 'seg.lo', 'rms', 't')} AS lps, {at('xb', 'yb', 'seg.lo', 'rms', 't')} AS bps,
        t - seg.lo < rms AS ramping, err AS base_error
        FROM r JOIN seg USING (sid) WHERE t >= seg.lo AND t < seg.hi),
    a1 AS (SELECT a0.*, coalesce(n_active, 0) AS n_active, coalesce(spike_error, 0::FLOAT) AS spike_error,
        coalesce(latency_multiplier, 0::FLOAT) AS latency_multiplier, coalesce(unusual, false) AS unusual, coalesce(active_spikes, 'none') AS active_spikes
        FROM a0 LEFT JOIN hit USING ({keys})),
    a AS (SELECT *, n_active > 0 AS spike_active, CASE WHEN n_active > 0 THEN greatest(base_error, spike_error) ELSE base_error END AS effective_error,
        trunc((CASE WHEN n_active > 0 THEN greatest(base_error, spike_error) ELSE base_error END) * 10000::FLOAT)::INT AS error_fp FROM a1)"""


MONTH_ROWS = f"SELECT event_id, ts, event_type, 'month' AS sid, epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '{X.MONTH_ORIGIN}') AS t FROM events"
CUSTOMER_ROWS = (
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, o_custkey::VARCHAR AS sid, "
    f"epoch_us(l_shipdate) // 1000 - epoch_ms(TIMESTAMP '{X.CUSTOMER_ORIGIN}') AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
)
EVENT_KEYS = "event_id"
LINE_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def month(select: str) -> str:
    return f"WITH RECURSIVE {state_ctes(MONTH_CONTROL, MONTH_ROWS, EVENT_KEYS)} {select}"


def customer(select: str) -> str:
    return f"WITH RECURSIVE {state_ctes(CUSTOMER_CONTROL, CUSTOMER_ROWS, LINE_KEYS)} {select}"


def fields(select: str, source: str = "SELECT *, l_shipdate AS ts FROM lineitem", keys: str = LINE_KEYS, rate: str = "0.01::FLOAT") -> str:
    return f"WITH {field_ctes(source, keys, rate=rate)} {select}"


def event_fields(select: str, rate: str = "0.01::FLOAT") -> str:
    return fields(select, "SELECT event_id, ts FROM events", EVENT_KEYS, rate)
