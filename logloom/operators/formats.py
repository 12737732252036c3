"""Record formatters: one row to one text line."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..session import split_long_methods

Fields = Callable[[str], Column]
Formatter = Callable[[Fields], Column]

DEFAULT_FORMAT = "apache"


def _combined(c: Fields) -> list[Column]:
    return [
        c("ip"), F.lit(" - "), c("username"), F.lit(" "), T.apache_ts(c("ts")),
        F.lit(' "'), c("method"), F.lit(" "), c("path"), F.lit(" "), c("protocol"),
        F.lit('" '), c("status").cast("string"), F.lit(" "), c("body_bytes").cast("string"),
        F.lit(' "'), c("referrer"), F.lit('" "'), c("user_agent"), F.lit('"'),
    ]


def apache_line(c: Fields) -> Column:
    return F.concat(*_combined(c))


def nginx_line(c: Fields) -> Column:
    """The combined line plus one request time, printed as the shortest FLOAT text."""
    return F.concat(*_combined(c), F.lit(" "), c("request_time").cast("string"))


def json_line(c: Fields) -> Column:
    keys = ["level", "service", "trace_id", "span_id", "message", "method", "path", "status", "duration_ms"]
    record = [T.iso_ts(c("ts")).alias("timestamp"), *[c(k).alias(k) for k in keys], c("ip").alias("client_ip")]
    return F.to_json(F.struct(*record))


def syslog_line(c: Fields) -> Column:
    level = c("syslog_level")
    return F.concat(
        F.lit("<"), T.priority(level).cast("string"), F.lit(">1 "), T.syslog_ts(c("ts")), F.lit(" "), c("host"),
        F.lit(" "), c("service"), F.lit(" "), c("pid").cast("string"), F.lit(" "), c("msg_id"),
        F.lit(' [meta request_id="'), c("request_id"), F.lit('" duration_ms="'), c("syslog_duration_ms").cast("string"),
        F.lit('" level="'), level, F.lit('"] '), T.level_message(level),
    )


def event_line(c: Fields) -> Column:
    """Tagged event object; separators between events belong to the payload."""
    tags = [c("service").alias("service"), c("host").alias("host"), T.event_level(c("status")).alias("level")]
    tags += [c("method").alias("method"), c("path").alias("path"), c("status").cast("string").alias("status")]
    metrics = [c("duration_ms").alias("response_time_ms"), F.lit(1).alias("request_count")]
    metrics += [c("request_size").alias("request_size"), c("body_bytes").alias("response_size")]
    return F.to_json(
        F.struct(c("event_epoch").alias("timestamp"), F.struct(*tags).alias("tags"), F.struct(*metrics).alias("metrics"))
    )


_FORMATTERS: dict[str, Formatter] = {
    "apache": apache_line,
    "nginx": nginx_line,
    "json": json_line,
    "syslog": syslog_line,
    "event": event_line,
}


# Fields each built-in format reads, so that only those are drawn.
_HTTP = ["ip", "username", "method", "path", "protocol", "status", "body_bytes", "referrer", "user_agent"]
FORMAT_FIELDS = {
    "apache": _HTTP,
    "nginx": [*_HTTP, "request_time"],
    "json": ["level", "service", "trace_id", "span_id", "message", "method", "path", "status", "duration_ms", "ip"],
    "syslog": ["syslog_level", "host", "service", "pid", "msg_id", "request_id", "syslog_duration_ms"],
    "event": ["event_epoch", "service", "host", "method", "path", "status", "duration_ms", "request_size", "body_bytes"],
}


def register_format(name: str, formatter: Formatter) -> None:
    """Add a format: a function from a field accessor to a text column."""
    _FORMATTERS[name] = formatter


def format_names() -> list[str]:
    return list(_FORMATTERS)


def format_ok(fmt: Column | str, aliases: Mapping[str, str] | None = None) -> Column:
    fmt = F.col(fmt) if isinstance(fmt, str) else fmt
    return F.coalesce(canonical_format(fmt, aliases).isin(*_FORMATTERS), F.lit(False))


def canonical_format(fmt: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Own name of a format; ``aliases`` maps other spellings to it."""
    for other, own in (aliases or {}).items():
        fmt = F.when(fmt == other, F.lit(own)).otherwise(fmt)
    return fmt


def render(
    df: DataFrame,
    fmt: str | Column = DEFAULT_FORMAT,
    ts_col: str = "ts",
    prefix: str = "",
    formats: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``line`` and ``n_bytes`` (newline included).

    ``fmt`` is a name, or a column when one table mixes formats (``formats``
    limits the names that may occur).  A name that is not registered is an
    error; in a column it gives a NULL line, which callers can reject.  Fields and
    lines of several formats make long methods: see :func:`split_long_methods`.
    """
    split_long_methods(df.sparkSession)

    def c(name: str) -> Column:
        return F.col(ts_col) if name == "ts" else F.col(prefix + name)

    if isinstance(fmt, str):
        if fmt not in _FORMATTERS:
            raise ValueError(f"unknown format {fmt!r}, use one of {format_names()}")
        line = _FORMATTERS[fmt](c)
    else:
        line = None
        for name in formats or _FORMATTERS:
            formatter = _FORMATTERS[name]
            cond = fmt == name
            line = F.when(cond, formatter(c)) if line is None else line.when(cond, formatter(c))
    out = df.withColumn("line", line)
    return out.withColumn("n_bytes", T.line_bytes("line"))


def estimated_line_bytes(fmt: Column) -> Column:
    out = None
    for name, size in V.FORMAT_SIZES:
        out = F.when(fmt == name, F.lit(size)) if out is None else out.when(fmt == name, F.lit(size))
    return out
