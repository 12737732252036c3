"""Timestamps, levels, messages and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import require_utc
from . import vocab as V
from .draws import Draws


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- timestamps (UTC; set spark.sql.session.timeZone=UTC for TIMESTAMP input) -----------------
def apache_ts(ts: Column | str) -> Column:
    require_utc()
    return F.concat(F.lit("["), F.date_format(_col(ts), "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000]"))


def iso_ts(ts: Column | str) -> Column:
    require_utc()
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def syslog_ts(ts: Column | str) -> Column:
    require_utc()
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_seconds(_col(ts).cast("timestamp"))


def epoch_jitter(ts: Column | str, d: Draws) -> Column:
    """Epoch seconds minus 0 or 1 second."""
    return epoch_seconds(ts) - d.u8(2, 48).bitwiseAND(F.lit(1))


def civil_date(epoch_s: Column | str) -> Column:
    """Epoch seconds to (year, month, day, hour, minute, second), UTC."""
    ts = F.timestamp_seconds(_col(epoch_s))
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    return F.struct(*[fn(ts).alias(name) for name, fn in parts.items()])


def coarse_ts(ts: Column | str, tick_ms: int) -> Column:
    """Time floored to a tick; rows in one tick share one timestamp."""
    ms = F.unix_millis(_col(ts).cast("timestamp"))
    return F.timestamp_millis(ms - F.pmod(ms, F.lit(tick_ms)))


# -- levels and messages ---------------------------------------------------------------------
def json_escape(text: Column | str) -> Column:
    """Escape quote, backslash, LF, CR and TAB for use inside a JSON string.

    Whole records go through ``to_json``, which also escapes other control
    characters; this function is the plain five-character rule.
    """
    out = _col(text)
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def level_from_status(status: Column | str, drawn: Column) -> Column:
    """JSON records: errors force the level, otherwise it is drawn."""
    status = _col(status)
    return F.when(status >= 500, F.lit("ERROR")).when(status >= 400, F.lit("WARN")).otherwise(drawn)


def event_level(status: Column | str) -> Column:
    status = _col(status)
    return F.when(status >= 500, F.lit("error")).when(status >= 400, F.lit("warn")).otherwise(F.lit("info"))


def status_message(status: Column | str) -> Column:
    status, out = _col(status), None
    for codes, text in V.STATUS_MESSAGES:
        cond = status.isin(*codes)
        out = F.when(cond, F.lit(text)) if out is None else out.when(cond, F.lit(text))
    return out.otherwise(F.lit(V.DEFAULT_STATUS_MESSAGE))


def syslog_level(d: Draws, error_rate: Column, drawn: Column) -> Column:
    """The error roll forces ERROR or WARN with equal odds, else the drawn level."""
    forced = F.when(d.coin(8, 48), F.lit("ERROR")).otherwise(F.lit("WARN"))
    return F.when(d.unit(8, 24) < error_rate.cast("float"), forced).otherwise(drawn)


def _by_level(level: Column, table: list, default: object) -> Column:
    out = None
    for name, value in table:
        out = F.when(level == name, F.lit(value)) if out is None else out.when(level == name, F.lit(value))
    return out.otherwise(F.lit(default))


def severity(level: Column | str) -> Column:
    return _by_level(_col(level), V.SEVERITIES, V.DEFAULT_SEVERITY)


def priority(level: Column | str) -> Column:
    return F.lit(V.SYSLOG_FACILITY * 8) + severity(level)


def level_message(level: Column | str) -> Column:
    return _by_level(_col(level), V.LEVEL_MESSAGES, V.DEFAULT_LEVEL_MESSAGE)


def line_bytes(line: Column | str) -> Column:
    """Bytes of a written line, newline included."""
    return (F.octet_length(_col(line)) + 1).cast("bigint")
