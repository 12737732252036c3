"""Scenario documents to control tables (R1) and overrides.

Python only turns TOML text into JSON text, one document at a time.  Defaults,
unions, durations and checks are Spark expressions over that JSON.
"""

from __future__ import annotations

import datetime
import json
import tomllib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.durations import duration_ms, duration_ok, est_throughput_mb, rate_lps
from ..operators.control import Control
from ..operators.formats import canonical_format, format_ok

_UNION = "string"  # nested objects arrive as JSON text
DOCUMENT_SCHEMA = (
    "scenario struct<name:string,total_duration:string>,"
    f"timeline array<struct<at:string,rate:{_UNION},duration:string,error_rate:float>>,"
    f"spikes array<struct<at:string,type:string,duration:string,error_rate:{_UNION},latency_multiplier:float,"
    "repeat:struct<count:bigint,interval:string,jitter:string>>>,"
    "rates map<string,struct<throughput_mb:int,logs_per_sec:bigint>>,"
    "format string"
)


#: Types of a document's values: a tuple lists alternatives, a table whose keys end in "!" needs them all.
_NUMBER = (int, float)
_LEVEL = {"throughput_mb!": int, "logs_per_sec!": int}
_SHAPE = {
    "scenario": {"name": str, "total_duration": str},
    "timeline": [{"at": str, "rate": (str, _LEVEL), "duration": str, "error_rate": _NUMBER}],
    "spikes": [{
        "at": str, "type": str, "duration": str, "error_rate": (int, float, {"min!": _NUMBER, "max!": _NUMBER}), "latency_multiplier": _NUMBER,
        "repeat": {"count": int, "interval": str, "jitter": str},
    }],
    "rates": {"*": _LEVEL},
    "format": str,
}


def shape_error(value: object, shape: object, path: str = "") -> str | None:
    """Where a document holds a value of another type, or half of a table that is needed whole."""
    if isinstance(shape, tuple):
        problems = [shape_error(value, s, path) for s in shape]
        return None if None in problems else problems[-1]
    if isinstance(shape, type):
        fits = isinstance(value, shape) and not isinstance(value, bool) and (shape is not int or value >= 0)
        return None if fits else f"wrong type: {path}"
    if isinstance(shape, list):
        parts = [(f"{path}[{i}]", v, shape[0]) for i, v in enumerate(value)] if isinstance(value, list) else None
    else:
        parts = [] if isinstance(value, dict) else None
        for key, inner in shape.items() if parts is not None else ():
            name = key.rstrip("!")
            if key == "*":
                parts += [(f"{path}.{k}", v, inner) for k, v in value.items()]
            elif name in value:
                parts.append((f"{path}.{name}", value[name], inner))
            elif key != name:
                return f"wrong type: {path} lacks {name}"
    if parts is None:
        return f"wrong type: {path}"
    return next((e for p, v, s in parts if (e := shape_error(v, s, p.lstrip(".")))), None)


@lru_cache(maxsize=1024)
def read_document(text: str | None) -> tuple[str | None, str | None]:
    """A document as JSON, or what keeps it from being one."""

    def plain(value: object) -> str:
        if isinstance(value, (datetime.date, datetime.time)):
            return value.isoformat()
        raise TypeError(type(value).__name__)

    try:
        doc = json.loads(json.dumps(tomllib.loads(text), default=plain))
    except (tomllib.TOMLDecodeError, TypeError, AttributeError) as problem:
        return None, f"not TOML: {problem}"
    problem = shape_error(doc, _SHAPE)
    return (None if problem else json.dumps(doc)), problem


def toml_to_json(df: DataFrame, text_col: str, id_col: str = "scenario_id") -> DataFrame:
    """Adds ``json`` and ``error``; each document is read on its own, in the task that holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [read_document(text) for text in batch[text_col]]
            yield pd.DataFrame({id_col: batch[id_col], "json": [r[0] for r in read], "error": [r[1] for r in read]})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} string, json string, error string")


def read_documents(text: Column) -> Column:
    """A column of documents as ``struct<json, error>``: one of them, or none where there is no document."""

    @F.pandas_udf("json string, error string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(None, None) if t is None else read_document(t) for t in part]
            yield pd.DataFrame({"json": [r[0] for r in rows], "error": [r[1] for r in rows]})

    return read(text)


def document_problem(text: Column, error: Column, doc: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Why a document is rejected; NULL for a good one, and for no document.

    ``error`` comes from :func:`read_documents`; ``doc`` is a column that holds its JSON parsed, as it is read many times.
    """
    return F.when(text.isNotNull(), F.coalesce(error, _document_error(doc, aliases)))


def _document_error(doc: Column, aliases: Mapping[str, str] | None) -> Column:
    bad_time = lambda c: c.isNull() | ~duration_ok(c)
    bad_optional = lambda c: c.isNotNull() & ~duration_ok(c)
    events = F.coalesce(doc["timeline"], F.array())
    spikes = F.coalesce(doc["spikes"], F.array())
    types = [name for name, _ in V.SPIKE_TYPES]
    fmt = canonical_format(doc["format"], aliases)
    return (
        F.when(doc["scenario"].isNull() | doc["scenario"]["name"].isNull(), F.lit("missing scenario name"))
        .when(bad_time(doc["scenario"]["total_duration"]), F.lit("bad total_duration"))
        .when(F.exists(events, lambda e: bad_time(e["at"]) | bad_optional(e["duration"])), F.lit("bad duration in timeline"))
        .when(F.exists(events, lambda e: e["rate"].isNull()), F.lit("missing rate in timeline"))
        .when(F.exists(spikes, lambda s: bad_time(s["at"]) | bad_time(s["duration"])), F.lit("bad duration in spikes"))
        .when(F.exists(spikes, lambda s: ~F.coalesce(s["type"].isin(*types), F.lit(False))), F.lit("unknown spike type"))
        .when(
            F.exists(
                spikes,
                lambda s: s["repeat"].isNotNull()
                & (s["repeat"]["count"].isNull() | bad_time(s["repeat"]["interval"]) | bad_optional(s["repeat"]["jitter"])),
            ),
            F.lit("bad repeat in spikes"),
        )
        .when(doc["format"].isNotNull() & ~format_ok(fmt), F.lit("unknown format"))
    )


def parse_documents(
    documents: DataFrame, aliases: Mapping[str, str] | None = None
) -> tuple[Control, DataFrame]:
    """Control tables of ``(scenario_id, json, error)`` rows, and the rejected documents."""
    read = documents.withColumn("doc", F.from_json("json", DOCUMENT_SCHEMA))
    read = read.withColumn("error", F.coalesce("error", _document_error(F.col("doc"), aliases)))
    good = read.filter("error is null").select("scenario_id", "doc.*")
    meta = good.select(
        "scenario_id",
        F.col("scenario.name").alias("name"),
        duration_ms(F.col("scenario.total_duration")).alias("total_ms"),
        canonical_format(F.col("format"), aliases).alias("format"),
    )
    events = good.select("scenario_id", F.posexplode("timeline").alias("idx", "e"))
    named = ~F.col("e.rate").startswith("{")
    explicit = F.from_json(F.col("e.rate"), "throughput_mb int, logs_per_sec bigint")
    timeline = events.select(
        "scenario_id",
        F.col("idx").cast("bigint").alias("idx"),
        duration_ms(F.col("e.at")).alias("at_ms"),
        F.when(named, F.col("e.rate")).alias("rate_name"),
        F.when(~named, explicit["logs_per_sec"]).alias("lps"),
        F.when(~named, explicit["throughput_mb"]).alias("mb"),
        duration_ms(F.col("e.duration")).alias("ramp_ms"),
        F.col("e.error_rate").alias("error_pct"),
    )
    spikes = good.select("scenario_id", F.posexplode("spikes").alias("spike_idx", "s"))
    ranged = F.from_json(F.col("s.error_rate"), "min float, max float")
    fixed = F.col("s.error_rate").try_cast("float")
    spikes = spikes.select(
        "scenario_id",
        F.col("spike_idx").cast("bigint").alias("spike_idx"),
        duration_ms(F.col("s.at")).alias("at_ms"),
        F.col("s.type").alias("type"),
        duration_ms(F.col("s.duration")).alias("dur_ms"),
        F.coalesce(fixed, ranged["min"]).alias("err_lo"),
        F.coalesce(fixed, ranged["max"]).alias("err_hi"),
        F.col("s.latency_multiplier").alias("lat_mult"),
        F.col("s.repeat.count").alias("rep_count"),
        duration_ms(F.col("s.repeat.interval")).alias("rep_interval_ms"),
        duration_ms(F.col("s.repeat.jitter")).alias("rep_jitter_ms"),
    )
    rates = good.select("scenario_id", F.explode("rates").alias("rate_name", "r")).select(
        "scenario_id", "rate_name", F.col("r.throughput_mb").alias("mb"), F.col("r.logs_per_sec").alias("lps")
    )
    rejected = read.filter("error is not null").select("scenario_id", "error")
    return Control(meta, timeline, spikes, rates), rejected


def load_scenarios(
    spark: SparkSession, glob: str, aliases: Mapping[str, str] | None = None
) -> tuple[Control, DataFrame]:
    """Read TOML scenario files; the file path is the scenario id."""
    files = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("scenario_id"), F.col("value").alias("text"))
    return parse_documents(toml_to_json(files, "text"), aliases)


def override_scenario(control: Control, rate: str | Column | None = None, fmt: str | Column | None = None) -> Control:
    """Replace the whole timeline by one event at 0 (no error rate), and / or the format; spikes stay.

    ``rate`` is a preset name or a number with optional K or M, or a column of
    ``control.meta`` that holds one per scenario.
    """
    out = control
    if rate is not None:
        text = F.lit(rate) if isinstance(rate, str) else rate
        lps = rate_lps(text)
        named = text.isin(*[name for name, _, _ in V.RATE_PRESETS])
        event = control.meta.select(
            "scenario_id",
            F.lit(0).cast("bigint").alias("idx"),
            F.lit(0).cast("bigint").alias("at_ms"),
            F.when(named, text).alias("rate_name"),
            F.when(~named, lps).alias("lps"),
            F.when(~named, est_throughput_mb(lps)).cast("int").alias("mb"),
            F.lit(None).cast("bigint").alias("ramp_ms"),
            F.lit(None).cast("float").alias("error_pct"),
            lps.isNotNull().alias("_ok"),
        )
        # An unreadable rate is an error, as a run with it would not start.
        checked = F.when(F.col("_ok"), F.col("scenario_id")).otherwise(
            F.raise_error(F.concat(F.lit("unknown rate for scenario "), F.col("scenario_id")))
        )
        out = out.with_(timeline=event.withColumn("scenario_id", checked).drop("_ok"))
    if fmt is not None:
        name = F.lit(fmt) if isinstance(fmt, str) else fmt
        unknown = F.raise_error(F.concat(F.lit("unknown format "), F.coalesce(name, F.lit("NULL")))).cast("string")
        out = out.with_(meta=control.meta.withColumn("format", F.when(F.coalesce(format_ok(name), F.lit(False)), name).otherwise(unknown)))
    return out
