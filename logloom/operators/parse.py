"""Lines back to columns, with a reject flag (V1-V5), and ingest accounting (V6).

Each parser validates a line with one pattern and then cuts it by separators;
lines that fail keep NULL fields and ``rejected`` = true, so no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMBINED = r'^\S+ - \S+ \[[^\]]+\] "\S+ [^"]+ \S+" \d{3} \d+ "[^"]*" "[^"]*"'
_PATTERNS = {
    "apache": _COMBINED + r"$",
    "nginx": _COMBINED + r" [0-9.E-]+$",
    "syslog": r'^<\d{1,3}>1 \S+ \S+ \S+ \d+ \S+ \[meta request_id="[^"]*" duration_ms="\d+" level="[^"]*"\] .*$',
}
#: Fields that are cast from text; a line whose text does not cast is rejected.
_REQUIRED = {
    "apache": ["ts", "status", "body_bytes"],
    "nginx": ["ts", "status", "body_bytes", "request_time"],
    "syslog": ["ts", "priority", "pid", "duration_ms"],
}
_JSON_SCHEMA = (
    "timestamp string, level string, service string, trace_id string, span_id string, message string, method string, "
    "path string, status int, duration_ms int, client_ip string"
)
_EVENT_SCHEMA = "timestamp bigint, tags map<string,string>, metrics map<string,double>, payload string"


def _word(text: Column, n: int) -> Column:
    return F.get(F.split(text, " "), F.lit(n))


def _utc(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


def _combined(line: Column) -> dict[str, Column]:
    quoted = F.split(line, '"')
    head, request, numbers = F.get(quoted, F.lit(0)), F.get(quoted, F.lit(1)), F.get(quoted, F.lit(2))
    method, protocol = F.substring_index(request, " ", 1), F.substring_index(request, " ", -1)
    path = F.substring(request, F.length(method) + 2, F.length(request) - F.length(method) - F.length(protocol) - 2)
    clock = F.substring_index(F.substring_index(head, "[", -1), "]", 1)
    return {
        "ip": _word(head, 0),
        "username": _word(head, 2),
        "ts": _utc(clock, "dd/MMM/yyyy:HH:mm:ss Z"),
        "method": method,
        "path": path,
        "protocol": protocol,
        "status": _word(numbers, 1).try_cast("int"),
        "body_bytes": _word(numbers, 2).try_cast("bigint"),
        "referrer": F.get(quoted, F.lit(3)),
        "user_agent": F.get(quoted, F.lit(5)),
    }


def _nginx(line: Column) -> dict[str, Column]:
    return _combined(line) | {"request_time": F.substring_index(line, " ", -1).try_cast("float")}


def _syslog(line: Column) -> dict[str, Column]:
    word = F.split(line, " ", 11)
    at = lambda n: F.get(word, F.lit(n))
    value = lambda c: F.substring_index(F.substring_index(c, '"', 2), '"', -1)
    return {
        "priority": F.substring_index(F.substring_index(at(0), ">", 1), "<", -1).try_cast("int"),
        "ts": _utc(at(1), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        "host": at(2),
        "service": at(3),
        "pid": at(4).try_cast("int"),
        "msg_id": at(5),
        "request_id": value(at(7)),
        "duration_ms": value(at(8)).try_cast("int"),
        "level": value(at(9)),
        "message": at(10),
    }


def parse_lines(df: DataFrame, fmt: str, line_col: str = "line") -> DataFrame:
    """Parsed fields next to the remaining columns; ``rejected`` marks lines that do not fit."""
    line = F.col(line_col)
    if fmt in ("json", "event"):
        return _parse_objects(df, fmt, line, line_col)
    fields = {"apache": _combined, "nginx": _nginx, "syslog": _syslog}[fmt](line)
    ok = F.coalesce(line.rlike(_PATTERNS[fmt]), F.lit(False))
    parsed = F.when(ok, F.struct(*[c.alias(n) for n, c in fields.items()]))
    others = [c for c in df.columns if c != line_col]
    return _strict(df.select(*others, parsed.alias("_p")), others, list(fields), _REQUIRED[fmt])


def _strict(df: DataFrame, others: list[str], fields: list[str], required: list[str]) -> DataFrame:
    """Fields of ``_p``, all NULL in a rejected row: one that did not parse or lacks a required field."""
    good = F.col("_p").isNotNull()
    for name in required:
        good = good & F.col(f"_p.{name}").isNotNull()
    df = df.select(*others, "_p", good.alias("_good"))
    return df.select(*others, *[F.when(F.col("_good"), F.col(f"_p.{f}")).alias(f) for f in fields], (~F.col("_good")).alias("rejected"))


def _parse_objects(df: DataFrame, fmt: str, line: Column, line_col: str) -> DataFrame:
    others = [c for c in df.columns if c != line_col]
    if fmt == "json":
        raw = F.from_json(line, _JSON_SCHEMA)
        names = ["level", "service", "trace_id", "span_id", "message", "method", "path", "status", "duration_ms"]
        out = df.select(*others, raw.alias("_r"))
        ts = _utc(F.col("_r.timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSX")
        out = out.select(*others, F.struct(ts.alias("ts"), *[F.col(f"_r.{n}") for n in names], F.col("_r.client_ip").alias("ip")).alias("_p"))
        return _strict(out, others, ["ts", *names, "ip"], ["ts", "status"])
    out = df.select(*others, F.from_json(line, _EVENT_SCHEMA).alias("_r"))
    tag = lambda k: F.col("_r.tags").getItem(k)
    metric = lambda k: F.col("_r.metrics").getItem(k)
    fields = {
        "event_epoch": F.col("_r.timestamp"),
        **{k: tag(k) for k in ("service", "host", "level", "method", "path")},
        "status": tag("status").try_cast("int"),
        "duration_ms": metric("response_time_ms").cast("int"),
        "request_size": metric("request_size").cast("int"),
        "body_bytes": metric("response_size").cast("bigint"),
    }
    # An event needs at least one tag and one metric.
    whole = (F.size("_r.tags") > 0) & (F.size("_r.metrics") > 0)
    out = out.select(*others, F.when(whole, F.struct(*[c.alias(n) for n, c in fields.items()])).alias("_p"))
    return _strict(out, others, list(fields), ["event_epoch"])


def explode_events(payloads: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per event of an envelope payload; tags and metrics stay maps.

    A payload is bounded by its batch size, so exploding it is a local step.
    """
    body = F.from_json(F.col(body_col), f"events array<struct<{_field_types()}>>")
    others = [c for c in payloads.columns if c != body_col]
    return payloads.select(*others, F.posexplode_outer(body["events"]).alias("pos", "e")).select(*others, "pos", "e.*")


def _field_types() -> str:
    return ", ".join(p.strip().replace(" ", ":", 1) for p in (
        "timestamp bigint", "tags map<string,string>", "metrics map<string,double>", "payload string"))


def ingest_report(payloads: DataFrame, id_col: str = "payload_id", body_col: str = "body") -> DataFrame:
    """Accepted and rejected events per envelope payload.

    An event needs a timestamp and at least one tag and one metric; a body that
    is not an envelope counts as one rejected row, an empty envelope as none.
    """
    broken = F.from_json(F.col(body_col), "events array<string>")["events"].isNull()
    events = explode_events(payloads.select(id_col, body_col, broken.alias("_broken")), body_col)
    ok = F.coalesce(
        F.col("timestamp").isNotNull() & (F.size("tags") > 0) & (F.size("metrics") > 0), F.lit(False)
    )
    return events.groupBy(id_col).agg(
        F.sum(ok.cast("bigint")).alias("accepted"),
        F.sum(F.when(F.col("pos").isNull(), F.col("_broken")).otherwise(~ok).cast("bigint")).alias("rejected"),
    )
