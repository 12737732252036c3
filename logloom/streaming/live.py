"""Structured Streaming forms.

Enrichment needs no streaming code of its own: ``attach_scenario``,
``with_log_fields`` and ``render`` are stateless projections or stream-static
joins and run on a streaming DataFrame as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vocab as V
from ..operators.metrics import is_error
from ..operators.payloads import DEFAULT_LIMIT, pack_partitions
from ..operators.sinks import MAX_RETRIES, Send, deliver


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Parquet file stream; the schema is explicit, as streams do not infer it."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def live_throughput(
    stream: DataFrame, ts_col: str, every: str = "500 milliseconds", delay: str = "10 seconds", error: Column | None = None
) -> DataFrame:
    """Logs, bytes and errors per tumbling interval of event time.

    The watermark drops rows later than ``delay``.  Append mode emits closed
    intervals only; use update or complete mode to see open ones.
    """
    error = is_error() if error is None else error
    rows = stream.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", delay)
    out = rows.groupBy(F.window("_ts", every).alias("w")).agg(
        F.count("*").alias("logs"), F.sum("n_bytes").alias("bytes"), F.sum(error.cast("bigint")).alias("errors")
    )
    seconds = (F.unix_millis("w.end") - F.unix_millis("w.start")) / F.lit(1000.0)
    return out.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "logs", "bytes", "errors",
        (F.col("logs") / seconds).alias("logs_per_s"),
        (F.col("bytes") / seconds / F.lit(float(V.MIB))).alias("mb_per_s"),
    )


def start_throughput(stream: DataFrame, ts_col: str, path: str, checkpoint: str, **kw) -> StreamingQuery:
    """Write closed intervals to parquet as they close; stops when the input is drained."""
    out = live_throughput(stream, ts_col, **kw)
    return (
        out.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def deliver_stream(
    stream: DataFrame,
    send: Send,
    attempts_path: str,
    checkpoint: str,
    limit_bytes: int = DEFAULT_LIMIT,
    max_retries: int = MAX_RETRIES,
    pause: Callable[[float], None] | None = None,
) -> StreamingQuery:
    """Pack and send each micro-batch, logging attempts under ``batch_id=N``.

    The log of a batch is overwritten as a whole, so a replayed batch leaves one
    log; payload ids carry the batch id, so receivers can drop repeats.
    """
    options = {} if pause is None else {"pause": pause}

    def run(batch: DataFrame, batch_id: int) -> None:
        payloads = pack_partitions(batch, limit_bytes)
        payloads = payloads.withColumn("payload_id", F.concat(F.lit(f"b{batch_id}-"), "payload_id"))
        deliver(payloads, send, max_retries, **options).write.mode("overwrite").parquet(f"{attempts_path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
