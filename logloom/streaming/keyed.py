"""Keyed state with event-time timers (W2 with late rows, W3).

Both queries use ``transformWithStateInPandas``: state lives in the query's checkpoint (RocksDB), so
a restart goes on where it stopped, and timers fire when the watermark passes them.  The watermark
column is dropped before the state, so Spark does not throw late rows away and the state can
treat them.  The session needs ``state_store(spark)`` before a query starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import vocab as V
from ..operators.metrics import is_error
from ..operators.spikes import INSTANCE_KEYS
from ..session import require_utc

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Choose the state store that keyed timers need; an explicit choice of the session stays."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


# -- W3 ----------------------------------------------------------------------------------------
class _Edges(StatefulProcessor):
    """Enter and exit of one spike instance, each when the clock reaches it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spike = handle.getValueState("spike", "type string, origin_ms bigint, enter_ms bigint, exit_ms bigint, total_ms bigint")

    def _rows(self, key: tuple, changes: list[tuple[str, int]], kind: str) -> pd.DataFrame:
        out = pd.DataFrame([(*key, kind, at, change) for change, at in changes], columns=[*INSTANCE_KEYS, "type", "at_ms", "change"])
        return out.astype({"spike_idx": "int64", "rep": "int64", "at_ms": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = next(iter(rows)).iloc[0]
        # A definition that a source repeats is taken once.
        if self.spike.exists():
            return
        kind, origin, total = str(first["type"]), int(first["origin_ms"]), int(first["total_ms"])
        enter, leave = max(int(first["start_ms"]), 0), int(first["end_ms"])
        self.spike.update((kind, origin, enter, leave, total))
        now, due = timerValues.getCurrentWatermarkInMs(), []
        for change, at in (("enter", enter), ("exit", leave)):
            if at >= total or leave <= enter:
                continue
            if origin + at <= now:
                due.append((change, at))
            else:
                self.handle.registerTimer(origin + at)
        if due:
            yield self._rows(key, due, kind)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kind, origin, enter, _, _ = self.spike.get()
        at = expiredTimerInfo.getExpiryTimeInMs() - origin
        yield self._rows(key, [("enter" if at == enter else "exit", at)], kind)

    def close(self) -> None:
        pass


TRANSITIONS = "scenario_id string, spike_idx bigint, rep bigint, type string, at_ms bigint, change string"


def stream_spike_transitions(instances: DataFrame, clock: DataFrame, ts_col: str, origin: str, delay: str = "10 seconds") -> DataFrame:
    """Enter and exit rows of spike instances as the event time of ``clock`` reaches them.

    ``instances`` is a stream with the columns of ``expand_spikes`` and ``total_ms``; definitions may
    come in any order and at any time.  One that comes after its start or end has passed is
    reported at once, so the log holds the same rows as ``spike_transitions`` over the same
    instances as soon as the clock has passed the end of the scenario.
    """
    require_utc()
    state_store(instances.sparkSession)
    start = F.unix_millis(F.lit(origin).cast("timestamp"))
    fields = [*INSTANCE_KEYS, "type", "start_ms", "end_ms", "total_ms"]
    known = {f.name: f.dataType for f in instances.schema.fields}
    spikes = instances.select(*fields, F.lit(None).cast("timestamp").alias("_at"))
    ticks = clock.select(*[F.lit(None).cast(known[f]).alias(f) for f in fields], F.col(ts_col).cast("timestamp").alias("_at"))
    both = spikes.unionAll(ticks).withWatermark("_at", delay)
    # The clock's rows end here.  The condition is on the watermark column: any other would be pushed below the watermark.
    rows = both.where(F.col("_at").isNull()).withColumn("origin_ms", start)
    rows = rows.select(F.col("scenario_id").cast("string").alias("scenario_id"), F.col("spike_idx").cast("bigint").alias("spike_idx"), F.col("rep").cast("bigint").alias("rep"), "type", "start_ms", "end_ms", "total_ms", "origin_ms")
    return rows.groupBy(*INSTANCE_KEYS).transformWithStateInPandas(_Edges(), TRANSITIONS, "Append", "EventTime")


# -- W2 ----------------------------------------------------------------------------------------
class _Interval(StatefulProcessor):
    """Sums of one interval until the watermark closes it; rows that come later are told apart."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "logs bigint, bytes bigint, errors bigint")

    def _row(self, key: tuple, kind: str, sums: tuple) -> pd.DataFrame:
        return pd.DataFrame({"start_ms": [key[0]], "end_ms": [key[1]], "kind": [kind], "logs": [sums[0]], "bytes": [sums[1]], "errors": [sums[2]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [0, 0, 0]
        for part in rows:
            new = [a + int(part[c].sum()) for a, c in zip(new, ("logs", "bytes", "errors"), strict=True)]
        if key[1] <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, "late", tuple(new))
            return
        if self.sums.exists():
            new = [a + b for a, b in zip(new, self.sums.get(), strict=True)]
        else:
            self.handle.registerTimer(key[1])
        self.sums.update(tuple(new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._row(key, "on time", self.sums.get())
        self.sums.clear()

    def close(self) -> None:
        pass


INTERVALS = "start_ms bigint, end_ms bigint, kind string, logs bigint, bytes bigint, errors bigint"


def throughput_with_late(stream: DataFrame, ts_col: str, every_ms: int = 500, delay: str = "10 seconds", error: Column | None = None) -> DataFrame:
    """Logs, bytes and errors per interval as it closes, and of rows behind the watermark.

    ``kind`` is ``on time`` once per closed interval; ``late`` rows come per micro-batch that
    brought rows of an interval already closed.  Both kinds together, and the intervals still open,
    hold every input row once.  Rows are summed per interval and partition before the state sees them.
    """
    require_utc()
    state_store(stream.sparkSession)
    error = is_error() if error is None else error
    at = F.unix_millis(F.col(ts_col).cast("timestamp"))
    start = (F.floor(at / F.lit(every_ms)) * F.lit(every_ms)).cast("bigint")
    rows = stream.withColumn("_at", F.col(ts_col).cast("timestamp")).withWatermark("_at", delay).select(
        start.alias("start_ms"), (start + every_ms).alias("end_ms"), F.lit(1).cast("bigint").alias("logs"),
        F.col("n_bytes").cast("bigint").alias("bytes"), F.coalesce(error.cast("bigint"), F.lit(0)).alias("errors"),
    )
    rows = rows.where(F.col("start_ms").isNotNull()).mapInPandas(_partial_sums, "start_ms bigint, end_ms bigint, logs bigint, bytes bigint, errors bigint")
    out = rows.groupBy("start_ms", "end_ms").transformWithStateInPandas(_Interval(), INTERVALS, "Append", "EventTime")
    seconds = F.lit(every_ms / 1000.0)
    return out.withColumns({"logs_per_s": F.col("logs") / seconds, "mb_per_s": F.col("bytes") / seconds / F.lit(float(V.MIB))})


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        yield part.groupby(["start_ms", "end_ms"], as_index=False)[["logs", "bytes", "errors"]].sum()
