"""Row sources: seeded fields on an existing table (R6) and rows generated from a scenario."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import text as T
from ..functions.draws import Draws
from ..operators.formats import FORMAT_FIELDS
from ..operators.spikes import repeat_numbers

DEFAULT_ERROR_RATE = 0.01

LOG_FIELDS = [
    "ip", "username", "method", "path", "protocol", "status", "body_bytes", "referrer", "user_agent", "request_time",
    "level", "service", "host", "trace_id", "span_id", "request_id", "msg_id", "pid", "duration_ms", "request_size",
    "message", "syslog_level", "syslog_duration_ms", "event_epoch",
]


def with_log_fields(
    df: DataFrame,
    keys: Sequence[str],
    ts_col: str,
    seed: int = 0,
    digest: str = "xxhash64",
    error_rate: Column | float = DEFAULT_ERROR_RATE,
    prefix: str = "",
    fields: Sequence[str] | None = None,
    pools: str = "broadcast",
    fmt: Column | None = None,
    formats: Sequence[str] = (),
) -> DataFrame:
    """Add seeded log fields to every row: a narrow projection, no exchange, no Python.

    ``keys`` identify a row (equal keys draw equal fields).  ``error_rate`` is a
    number or a column such as ``error_rate`` of an attached scenario.  ``fields``
    limits the added columns.  The large pools (``ip``, ``path``) are
    looked up in broadcast tables of fixed size; ``pools="inline"`` evaluates the
    same values in place instead, with no broadcast at all.  With ``fmt``, a row
    that becomes a line of one of ``formats``, only the fields that this format
    reads are drawn, and the others are NULL: a line costs what its own format does.
    """
    wanted = LOG_FIELDS if fields is None else list(fields)
    readers = _readers(wanted, formats) if fmt is not None else {}

    def only(names: Sequence[str], value: Column) -> Column:
        where = _read_by(fmt, formats, [r for n in names for r in readers.get(n, ())])
        return value if where is None else F.when(where, value)

    def word(no: int) -> Column | None:
        return _read_by(fmt, formats, [r for n, words in X.FIELD_WORDS.items() if no in words for r in readers.get(n, ())])

    # User agents are pooled for mixed formats only, where they would be evaluated several times inside a condition.
    pooled = [f for f in X.POOLS if f in wanted and (f != "user_agent" or fmt is not None)] if pools == "broadcast" else []
    rate = F.lit(float(error_rate)) if isinstance(error_rate, (int, float)) else error_rate
    df, d = Draws(keys, seed, digest).materialize(df, X.N_WORDS, where={no: c for no in range(X.N_WORDS) if (c := word(no)) is not None})
    for name in pooled:
        df = X.with_pool_field(df, d, name, _read_by(fmt, formats, readers.get(name, ())))
    # Status and levels feed several fields, so they are computed once, before them.
    status, drawn = F.col("_status"), F.col("_drawn_level")
    df = df.withColumns({"_status": only(["_status"], X.http_status(d, rate)), "_drawn_level": only(["_drawn_level"], X.log_level(d))})
    if "syslog_level" in wanted:
        df = df.withColumn("_syslog_level", only(["syslog_level"], T.syslog_level(d, rate, drawn)))
    build = {
        "ip": lambda: X.ip_address(d),
        "username": lambda: X.username(d),
        "method": lambda: X.http_method(d),
        "path": lambda: X.url_path(d),
        "protocol": lambda: X.protocol(d),
        "status": lambda: status,
        "body_bytes": lambda: X.response_size(d, status),
        "referrer": lambda: X.referrer(d),
        "user_agent": lambda: X.user_agent(d),
        "request_time": lambda: X.request_seconds(d, status),
        "level": lambda: T.level_from_status(status, drawn),
        "service": lambda: X.service(d),
        "host": lambda: X.host(d),
        "trace_id": lambda: X.trace_id(d),
        "span_id": lambda: X.span_id(d),
        "request_id": lambda: X.request_id(d),
        "msg_id": lambda: X.message_id(d),
        "pid": lambda: X.process_id(d),
        "duration_ms": lambda: X.duration_ms_for(d, status),
        "request_size": lambda: X.request_size(d),
        "message": lambda: T.status_message(status),
        "syslog_level": lambda: F.col("_syslog_level"),
        "syslog_duration_ms": lambda: X.syslog_duration(d),
        "event_epoch": lambda: T.epoch_jitter(ts_col, d),
    }
    build |= {name: lambda name=name: F.col(f"_pool_{name}") for name in pooled}
    copied = {"status", "syslog_level", *pooled}
    out = df.withColumns({prefix + name: build[name]() if name in copied else only([name], build[name]()) for name in wanted})
    return out.select(*_kept(out))


def _readers(wanted: Sequence[str], formats: Sequence[str]) -> dict[str, list[str]]:
    """Formats that read each field, or a field made from it."""
    out: dict[str, list[str]] = {}
    for name in formats:
        for field in FORMAT_FIELDS[name]:
            for part in (field, *X.FIELD_PARTS.get(field, ())) if field in wanted else ():
                out.setdefault(part, []).append(name)
    return out


def _read_by(fmt: Column | None, formats: Sequence[str], readers: Sequence[str]) -> Column | None:
    """Condition that a row's format is a reader; None where no row need be left out."""
    names = [name for name in formats if name in readers]
    return None if fmt is None or len(names) in (0, len(formats)) else fmt.isin(*names)


def _kept(df: DataFrame) -> list[str]:
    """All columns but the helpers."""
    helpers = {"_status", "_drawn_level", "_syslog_level", *[f"_pool_{n}" for n in X.POOLS]}
    return [c for c in df.columns if c not in helpers and not (c.startswith("_w") and c[2:].isdigit())]


def generate_rows(
    budget: DataFrame,
    bucket_ms: int,
    origin: str,
    chunk: int = 65_536,
    keep: Sequence[str] = (),
    spread_by: Sequence[str] = ("scenario_id", "bucket"),
    parts: int | None = None,
    block: str | None = None,
) -> DataFrame:
    """Rows of a run: as many per bucket as :func:`row_budget` says, evenly spaced inside it.

    The key ``(scenario_id, bucket, i)`` is stable, so fields drawn from it do
    not depend on partitioning.  Blocks of ``chunk`` rows are dealt over the
    cluster before they expand, so one bucket may hold most of the run.  ``keep``
    names columns of the budget that every row gets.  Columns ``spread_by`` and the
    block's number, which rows keep as ``block``, say how they are dealt, over ``parts`` partitions.
    """
    rows = repeat_numbers(budget.filter("n_rows > 0"), F.col("n_rows"), "i", chunk, list(spread_by), parts, block)
    offset = F.col("bucket") * F.lit(bucket_ms) + F.expr(f"cast(i as decimal(20,0)) * cast({bucket_ms} as decimal(18,0)) div n_rows")
    start = F.unix_millis(F.lit(origin).cast("timestamp"))
    return rows.select("scenario_id", "bucket", "i", offset.alias("t_ms"), F.timestamp_millis(start + offset).alias("ts"), *keep, *([block] if block else []))
