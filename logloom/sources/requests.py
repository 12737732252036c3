"""Run requests as JSON rows: checks, defaults, scenario and output rows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import duration_ms, duration_ok
from ..operators.control import Control
from ..operators.formats import canonical_format, format_ok
from ..operators.payloads import batch_format, content_type
from ..session import written
from .scenarios import DOCUMENT_SCHEMA, document_problem, parse_documents, read_documents, shape_error

# Defaults of a request.
DEFAULTS = {"format": "event", "rate": "low", "batch_kb": 1024, "timeout_s": 30, "senders": 8, "name": "remote"}
MAX_RETRIES = 3
#: Fields of a request and their types; "!" marks those that must be there.
REQUEST_SHAPE = {
    "output": str, "duration": str, "format": str, "rate": (str, {"throughput_mb!": int, "logs_per_sec!": int}), "http_auth": str,
    "http_headers": [{"name!": str, "value!": str}], "http_batch_kb": int, "http_timeout": int, "http_senders": int, "threads": int,
    "scenario_toml": str,
}
OPTIONAL = ("rate", "http_auth", "threads", "scenario_toml")

REQUEST_SCHEMA = (
    "output string, duration string, format string, rate string, http_auth string, "
    "http_headers array<struct<name:string,value:string>>, http_batch_kb bigint, http_timeout bigint, "
    "http_senders bigint, threads bigint, scenario_toml string, _corrupt string"
)


def _read(df: DataFrame, json_col: str, aliases: Mapping[str, str] | None) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    out = df.withColumn("r", F.from_json(F.col(json_col), REQUEST_SCHEMA, options))
    fmt = F.coalesce(canonical_format(F.col("r.format"), aliases), F.lit(DEFAULTS["format"]))
    out = out.withColumns({"fmt": fmt, "wrong": _wrong_shape(F.col(json_col)), "inline": read_documents(F.col("r.scenario_toml"))})
    out = out.withColumn("doc", F.from_json("inline.json", DOCUMENT_SCHEMA))
    out = out.withColumn("wrong_inline", document_problem(F.col("r.scenario_toml"), F.col("inline.error"), F.col("doc"), aliases)).drop("doc")
    return out.withColumn("error", request_error(F.col("r"), F.col("fmt"), F.col("wrong"), F.col("wrong_inline"))).drop("wrong", "wrong_inline")


def _wrong_shape(text: Column) -> Column:
    """Where a JSON object holds a value of a wrong type, or half of one; other texts are left to the parser."""

    def problem(text: str | None) -> str | None:
        try:
            request = json.loads(text)
        except (TypeError, ValueError):
            return None
        if not isinstance(request, dict):
            return "not an object"
        return shape_error({k: v for k, v in request.items() if v is not None or k not in OPTIONAL}, REQUEST_SHAPE)

    @F.pandas_udf("string")
    def wrong(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([problem(t) for t in part], dtype=object)

    return wrong(text)


def request_error(request: Column, fmt: Column, wrong: Column, wrong_inline: Column) -> Column:
    """First problem of a request, in the order a run would meet them; NULL when it is fine."""
    url = request["output"]
    inline = request["scenario_toml"].isNotNull()
    return (
        F.when(request.isNull() | request["_corrupt"].isNotNull(), F.lit("invalid JSON"))
        .when(url.isNull(), F.lit("invalid JSON: missing field output"))
        .when(request["duration"].isNull(), F.lit("invalid JSON: missing field duration"))
        .when(wrong.isNotNull(), F.concat(F.lit("invalid JSON: "), wrong))
        .when(wrong_inline.isNotNull(), F.concat(F.lit("invalid scenario document: "), wrong_inline))
        .when(~inline & ~duration_ok(request["duration"]), F.concat(F.lit("invalid duration '"), request["duration"], F.lit("'")))
        .when(~format_ok(fmt), F.concat(F.lit("unknown format '"), fmt, F.lit("'")))
        .when(
            ~url.startswith("http://") & ~url.startswith("https://"),
            F.concat(F.lit("output must be an HTTP URL, got '"), url, F.lit("'")),
        )
    )


def validate_requests(df: DataFrame, json_col: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """The input with an ``error`` column; NULL means accepted."""
    return _read(df, json_col, aliases).drop("r", "fmt", "inline")


def expand_requests(
    df: DataFrame, json_col: str, id_col: str, aliases: Mapping[str, str] | None = None
) -> dict[str, DataFrame | Control]:
    """Accepted requests as ``control`` tables and ``outputs`` rows with defaults filled.

    Without an inline document a request is one event at 0 and no spikes.  An
    inline document wins over duration and rate, while the request's format
    still overrides.  The checked requests are written once and read back: every
    table given would parse them all again.
    """
    read = _read(df, json_col, aliases)
    read = written(read.select(F.col(id_col).cast("string").alias("scenario_id"), "r", "fmt", F.col("inline.json").alias("inline"), "error"), "requests")
    good = read.filter("error is null")
    plain = good.filter(F.col("r.scenario_toml").isNull())
    rate = F.coalesce(F.col("r.rate"), F.lit(DEFAULTS["rate"]))
    explicit = F.from_json(rate, "throughput_mb int, logs_per_sec bigint")
    named = ~rate.startswith("{")
    null = lambda t: F.lit(None).cast(t)
    meta = plain.select("scenario_id", F.lit(DEFAULTS["name"]).alias("name"), duration_ms(F.col("r.duration")).alias("total_ms"), F.col("fmt").alias("format"))
    timeline = plain.select(
        "scenario_id",
        F.lit(0).cast("bigint").alias("idx"),
        F.lit(0).cast("bigint").alias("at_ms"),
        F.when(named, rate).alias("rate_name"),
        F.when(~named, explicit["logs_per_sec"]).alias("lps"),
        F.when(~named, explicit["throughput_mb"]).alias("mb"),
        null("bigint").alias("ramp_ms"),
        null("float").alias("error_pct"),
    )
    outputs = good.select(
        "scenario_id",
        F.col("r.output").alias("url"),
        F.col("fmt").alias("format"),
        (F.coalesce("r.http_batch_kb", F.lit(DEFAULTS["batch_kb"])) * 1024).alias("batch_bytes"),
        F.coalesce("r.http_timeout", F.lit(DEFAULTS["timeout_s"])).cast("bigint").alias("timeout_s"),
        F.coalesce("r.http_senders", F.lit(DEFAULTS["senders"])).cast("bigint").alias("senders"),
        F.lit(MAX_RETRIES).alias("max_retries"),
        F.col("r.http_auth").alias("auth"),
        F.coalesce(F.size("r.http_headers"), F.lit(0)).alias("n_headers"),
        F.col("r.http_headers").alias("headers"),
        batch_format(F.col("fmt")).alias("batch_format"),
        content_type(F.col("fmt")).alias("content_type"),
    )
    rejected = read.filter("error is not null").select("scenario_id", "error")
    # Documents with a problem are among the rejected requests.
    inline = good.filter(F.col("r.scenario_toml").isNotNull())
    docs, _ = parse_documents(inline.select("scenario_id", F.col("inline").alias("json"), null("string").alias("error")), aliases)
    forced = docs.meta.drop("format").join(inline.select("scenario_id", F.col("fmt").alias("format")), "scenario_id")
    control = Control(
        meta.unionByName(forced), timeline.unionByName(docs.timeline), docs.spikes, docs.rates
    )
    return {"control": control, "outputs": outputs, "rejected": rejected}
