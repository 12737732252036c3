"""Scenarios over the test tables: one month over ``events``, one scenario per customer."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..operators.attach import States
from ..operators.control import META_SCHEMA, SPIKES_SCHEMA, TIMELINE_SCHEMA, Control

SEED = 42
DIGEST = "md5"
HOUR = 3_600_000
DAY = 24 * HOUR

MONTH_ORIGIN = "2024-01-01 00:00:00"
MONTH_TOTAL = 696 * HOUR
MONTH_TIMELINE = [
    # idx, at, rate name, logs/s, MB/s, ramp, error percent
    (0, 0, "low", None, None, None, 0.5),
    (1, 48 * HOUR, "ramp_to_full", None, None, 24 * HOUR, None),
    (2, 60 * HOUR, "ramp_to_low", None, None, 12 * HOUR, None),
    (3, 96 * HOUR, "full", None, None, None, 1.0),
    (4, 90 * HOUR, "medium", None, None, None, None),
    (5, 240 * HOUR, "nosuch", None, None, None, 5.7),
    (6, 480 * HOUR, None, 0, 7, None, None),
    (7, 500 * HOUR, "max", None, None, None, 2.0),
]
MONTH_SPIKES = [
    # idx, at, type, duration, error low, error high, latency, repeat count, interval, jitter
    (0, 120 * HOUR, "error_burst", 24 * HOUR, 50.0, 50.0, None, None, None, None),
    (1, 130 * HOUR, "latency_spike", 24 * HOUR, None, None, 10.0, None, None, None),
    (2, 140 * HOUR, "mixed", 8 * HOUR, 80.0, 80.0, 5.0, None, None, None),
    (3, 200 * HOUR, "unusual_patterns", 24 * HOUR, None, None, None, None, None, None),
    (4, 300 * HOUR, "error_burst", 6 * HOUR, 20.0, 80.0, None, 10, 24 * HOUR, 5 * HOUR),
    (5, 650 * HOUR, "mixed", 12 * HOUR, None, None, None, None, None, None),
]

CUSTOMER_ORIGIN = "1995-01-01 00:00:00"
CUSTOMER_TOTAL = 1096 * DAY

# The customers' scripts on a short clock: a day takes 20 ms, the three years 22 s.
SHORT_DAY = 20
SHORT_TOTAL = 1096 * SHORT_DAY

EVENT_KEYS = ["event_id"]
LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few fixed rows as a local relation (no Python workers at run time)."""
    struct = _parse_datatype_string(schema)
    frame = spark.createDataFrame(pa.table({"_": [0]}))
    cells = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, struct.fields, strict=True)]) for row in rows
    ]
    return frame.select(F.inline(F.array(*cells)))


def month_control(spark: SparkSession) -> Control:
    name = "month"
    return Control(
        literal_table(spark, [(name, name, MONTH_TOTAL, None)], META_SCHEMA),
        literal_table(spark, [(name, *row) for row in MONTH_TIMELINE], TIMELINE_SCHEMA),
        literal_table(spark, [(name, *row) for row in MONTH_SPIKES], SPIKES_SCHEMA),
    )


def customer_control(spark: SparkSession, sf_dir: str) -> Control:
    """Orders as scripts: two thirds are timeline events, one third spikes, in order-key order."""
    orders = table(spark, sf_dir, "orders")
    key, sid = F.col("o_orderkey"), F.col("o_custkey").cast("string").alias("scenario_id")
    at = (F.unix_millis(F.col("o_orderdate").cast("timestamp")) - F.unix_millis(F.lit(CUSTOMER_ORIGIN).cast("timestamp"))).alias("at_ms")
    null = lambda t: F.lit(None).cast(t)
    meta = orders.select(sid).distinct().select(
        "scenario_id", F.col("scenario_id").alias("name"), F.lit(CUSTOMER_TOTAL).cast("bigint").alias("total_ms"), null("string").alias("format")
    )
    priority = F.substring("o_orderpriority", 1, 1)
    rate = (
        F.when(priority == "1", "full").when(priority == "2", "high").when(priority == "3", "ramp_to_full")
        .when(priority == "4", "unknown").otherwise("ramp_to_low")
    )
    timeline = orders.filter(key % 3 != 0).select(
        sid,
        key.alias("idx"),
        at,
        rate.alias("rate_name"),
        null("bigint").alias("lps"),
        null("int").alias("mb"),
        F.when(priority == "3", F.lit(30 * DAY)).cast("bigint").alias("ramp_ms"),
        F.when(key % 4 != 0, (key % 100).cast("double") / 10.0).cast("float").alias("error_pct"),
    )
    kind = F.get(F.array(*[F.lit(t) for t in ("error_burst", "latency_spike", "unusual_patterns", "mixed")]), (F.floor(key / 3) % 4).cast("int"))
    status = F.col("o_orderstatus")
    spikes = orders.filter(key % 3 == 0).select(
        sid,
        key.alias("spike_idx"),
        at,
        kind.alias("type"),
        ((F.lit(20) + key % 181) * F.lit(DAY)).cast("bigint").alias("dur_ms"),
        F.when(status == "F", 20.0).when(status == "P", 50.0).cast("float").alias("err_lo"),
        F.when(status == "F", 80.0).when(status == "P", 50.0).cast("float").alias("err_hi"),
        F.when(key % 5 != 0, 1 + key % 10).cast("float").alias("lat_mult"),
        F.when(key % 7 != 0, key % 4).cast("bigint").alias("rep_count"),
        F.lit(60 * DAY).cast("bigint").alias("rep_interval_ms"),
        F.lit(5 * DAY).cast("bigint").alias("rep_jitter_ms"),
    )
    return Control(meta, timeline, spikes)


def short_control(spark: SparkSession, sf_dir: str) -> Control:
    """The customers' scripts on the short clock, with small rates of their own, so that every planned row can be made."""
    control = customer_control(spark, sf_dir)
    short = lambda c: F.floor(F.col(c) / F.lit(DAY)) * F.lit(SHORT_DAY)
    key = F.col("scenario_id").cast("bigint")
    rate = lambda name, mb, lps: F.struct(F.lit(name).alias("rate_name"), mb.cast("int").alias("mb"), lps.cast("bigint").alias("lps"))
    rates = control.meta.select("scenario_id", F.inline(F.array(
        rate("low", F.lit(1), 1 + key % 3), rate("full", F.lit(3), 5 + key % 4), rate("high", 1 + key % 2, F.lit(4)), rate("medium", F.lit(2), F.lit(2)),
    )))
    return control.with_(
        meta=control.meta.withColumn("total_ms", F.lit(SHORT_TOTAL).cast("bigint")),
        timeline=control.timeline.withColumns({c: short(c).cast("bigint") for c in ("at_ms", "ramp_ms")}),
        spikes=control.spikes.withColumns({c: short(c).cast("bigint") for c in ("at_ms", "dur_ms", "rep_interval_ms", "rep_jitter_ms")}),
        rates=rates,
    )


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their customer: the rows that customer scenarios apply to."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEYS, "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey"))
    return lines.join(orders, "l_orderkey")


_MEMO: dict[tuple, States] = {}


def _memo(spark: SparkSession, key: tuple, build) -> States:
    """State tables are control data; one run computes them once and reads the checkpoint after."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def month_states(spark: SparkSession, describe: bool = False) -> States:
    return _memo(spark, ("month", describe), lambda: States.of(month_control(spark), SEED, DIGEST, describe))


def customer_states(spark: SparkSession, sf_dir: str, describe: bool = False) -> States:
    build = lambda: States.of(customer_control(spark, sf_dir), SEED, DIGEST, describe)
    return _memo(spark, ("customer", sf_dir, describe), build)
