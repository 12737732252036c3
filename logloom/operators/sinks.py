"""Sinks: files, console, discard, delivery with retries, accounting (K1-K3, K8, K9)."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from http.client import HTTPException
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Retries, backoff 10 ms doubled per attempt up to 2^6, jitter up to half of it.
MAX_RETRIES = 3
BACKOFF_MS = 10
BACKOFF_CAP = 6

ATTEMPT_SCHEMA = "payload_id string, attempt int, http_status int, n_bytes bigint"

# send(payload as dict) returns an HTTP status; raising means a network error.
Send = Callable[[dict], int]


def write_lines(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None,
                partition_by: tuple[str, ...] = ()) -> None:
    """Write ``line`` as text files (one per task), optionally partitioned by columns."""
    writer = df.select(*partition_by, "line").write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def write_stdout(df: DataFrame) -> None:
    """Every line to the standard output of the task that holds it; the driver's output sees none of them."""

    def emit(rows: Iterator) -> None:
        for row in rows:
            print(row["line"], flush=True)

    df.select("line").foreachPartition(emit)


def discard(df: DataFrame) -> None:
    """Compute every row and drop it."""
    df.write.format("noop").mode("overwrite").save()


def request_headers(content_type: str, auth: str | None = None, custom: Mapping[str, str] | None = None) -> dict[str, str]:
    headers = {"Content-Type": content_type}
    if auth is not None:
        headers["Authorization"] = auth
    return headers | dict(custom or {})


def http_sender(url: str, headers: Mapping[str, str], timeout_s: float = 30.0) -> Send:
    """A ``send`` that POSTs the body; error statuses are returned, network errors raise."""

    def send(payload: dict) -> int:
        request = urllib.request.Request(url, data=payload["body"].encode(), headers=dict(headers), method="POST")
        try:
            with urllib.request.urlopen(request, timeout=timeout_s) as reply:
                return reply.status
        except urllib.error.HTTPError as error:
            return error.code

    return send


def backoff_ms(attempt: int, rng: random.Random) -> float:
    base = BACKOFF_MS << min(attempt, BACKOFF_CAP)
    return base + rng.randint(0, base // 2)


def deliver(
    payloads: DataFrame,
    send: Send,
    max_retries: int = MAX_RETRIES,
    pause: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Send each payload from the task that holds it; one output row per attempt.

    2xx ends a payload; 5xx and network errors (NULL status) are retried up to
    ``max_retries`` times after a jittered backoff; other statuses drop it.  A
    task that Spark retries sends again, so receivers should treat
    ``payload_id`` as an idempotency key.  Write the result once (or checkpoint
    it) before using it twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = random.Random()
        for batch in batches:
            out = []
            for payload in batch.to_dict("records"):
                for attempt in range(max_retries + 1):
                    if attempt:
                        pause(backoff_ms(attempt, rng) / 1000.0)
                    try:
                        status = int(send(payload))
                    except (OSError, HTTPException):
                        status = None
                    out.append((payload["payload_id"], attempt, status, int(payload["n_bytes"])))
                    if status is not None and status < 500:
                        break
            frame = pd.DataFrame(out, columns=["payload_id", "attempt", "http_status", "n_bytes"])
            yield frame.astype({"http_status": "Int32"})

    return payloads.select("payload_id", "fmt", "n_rows", "n_bytes", "body").mapInPandas(run, ATTEMPT_SCHEMA)


def attempt_outcome(status: Column, attempt: Column, max_retries: int = MAX_RETRIES) -> Column:
    """delivered, retry or dropped."""
    retryable = status.isNull() | ((status >= 500) & (status <= 599))
    return (
        F.when(status.between(200, 299), F.lit("delivered"))
        .when(retryable & (attempt < max_retries), F.lit("retry"))
        .otherwise(F.lit("dropped"))
    )


def payload_outcomes(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Final state per payload: the outcome of its last attempt.

    ``max_by`` keeps one candidate per payload and task, so no attempts are
    sorted or collected.  Repeats of an attempt number (a replayed task) resolve
    to the highest status.
    """
    latest = F.col("attempt").cast("bigint") * F.lit(1000) + F.coalesce("http_status", F.lit(0))
    out = attempts.groupBy("payload_id").agg(
        F.count("*").alias("attempts"),
        F.count("http_status").alias("responses"),
        F.max("attempt").alias("last_attempt"),
        F.max_by("http_status", latest).alias("last_status"),
        F.max_by("n_bytes", latest).alias("n_bytes"),
    )
    return out.withColumn("outcome", attempt_outcome(F.col("last_status"), F.col("last_attempt"), max_retries))


def delivery_report(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Counters: bytes of delivered payloads, responses received, payloads given up."""
    done = payload_outcomes(attempts, max_retries)
    return done.agg(
        F.coalesce(F.sum(F.when(F.col("outcome") == "delivered", F.col("n_bytes"))), F.lit(0)).alias("bytes_written"),
        F.coalesce(F.sum("responses"), F.lit(0)).alias("requests_sent"),
        F.sum((F.col("outcome") == "dropped").cast("bigint")).alias("requests_failed"),
        F.sum((F.col("outcome") == "retry").cast("bigint")).alias("requests_pending"),
    )
