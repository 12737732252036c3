import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logloom.operators.spikes import expand_spikes, spike_transitions
from logloom.plans import fixtures as X
from logloom.streaming.keyed import stream_spike_transitions, throughput_with_late
from logloom.streaming.live import read_stream

INSTANCES = "scenario_id string, spike_idx bigint, rep bigint, type string, start_ms bigint, end_ms bigint, total_ms bigint"


def put(folder, name, table):
    folder.mkdir(exist_ok=True)
    pq.write_table(table, folder / f"{name}.parquet")


def drain(df, path, checkpoint):
    query = df.writeStream.outputMode("append").format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    query.exception() and pytest.fail(str(query.exception()))


def millis(hours):
    return 1_704_067_200_000 + int(hours * 3_600_000)


def clock(hours):
    return pa.table({"ts": pa.array([millis(h) * 1000 for h in hours], pa.timestamp("us", "UTC"))})


def test_spike_transitions_as_a_stream(spark, tmp_path):
    """Definitions unordered, repeated and after their time, with a restart in between: the same log as the batch form."""
    control = X.month_control(spark)
    instances = expand_spikes(control.spikes, X.SEED, X.DIGEST)
    expected = sorted(map(tuple, spike_transitions(instances, control.meta).select("scenario_id", "spike_idx", "rep", "type", "at_ms", "change").collect()))
    rows = instances.join(control.meta.select("scenario_id", "total_ms"), "scenario_id").select(*[f.split()[0] for f in INSTANCES.split(", ")]).toArrow()
    order = list(range(rows.num_rows))
    random.Random(1).shuffle(order)
    defs, ticks = tmp_path / "defs", tmp_path / "ticks"

    def go():
        # Two streams that are read again from the same checkpoint: each call is a restart.
        spikes = read_stream(spark, str(defs), INSTANCES)
        times = read_stream(spark, str(ticks), "ts timestamp")
        drain(stream_spike_transitions(spikes, times, "ts", X.MONTH_ORIGIN, "1 hour"), tmp_path / "out", tmp_path / "check")
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    half = len(order) // 2
    put(defs, "a", rows.take(order[:half]))
    put(ticks, "a", clock([0, 310, 150]))
    first = go()
    assert first and set(first) < set(expected) and all(at <= 309 * X.HOUR for *_, at, _ in first)
    # Now come the others, many of them long over, and the first ones once more.
    put(defs, "b", rows.take(order))
    put(ticks, "b", clock([20, 420]))
    second = go()
    assert set(first) <= set(second) and len(second) == len(set(second))
    put(ticks, "c", clock([700.5]))
    assert go() == expected


def test_late_rows_are_counted(spark, tmp_path):
    source, schema = tmp_path / "in", "ts timestamp, n_bytes bigint, status int"

    def rows(hours, status=200):
        return clock(hours).append_column("n_bytes", pa.array([10] * len(hours), pa.int64())).append_column("status", pa.array([status] * len(hours), pa.int32()))

    def go():
        out = throughput_with_late(read_stream(spark, str(source), schema), "ts", 3_600_000, "30 minutes")
        drain(out, tmp_path / "out", tmp_path / "check")
        return spark.read.parquet(str(tmp_path / "out"))

    put(source, "a", rows([0.1, 0.2, 1.1, 1.2, 3.9]))
    go()
    put(source, "b", rows([0.3, 1.7, 3.1, 6.9], 500))
    go()
    put(source, "c", rows([0.9, 2.2, 3.2, 99.0], 404))
    out = go()
    got = {(r.kind, (r.start_ms - millis(0)) // 3_600_000): (r.logs, r.bytes, r.errors) for r in out.groupBy("kind", "start_ms").agg(F.sum("logs").alias("logs"), F.sum("bytes").alias("bytes"), F.sum("errors").alias("errors")).collect()}
    assert got == {
        ("on time", 0): (2, 20, 0), ("on time", 1): (2, 20, 0), ("on time", 3): (2, 20, 1), ("on time", 6): (1, 10, 1),
        ("late", 0): (2, 20, 2), ("late", 1): (1, 10, 1), ("late", 2): (1, 10, 1), ("late", 3): (1, 10, 1),
    }
    # All but the row that holds the last interval open.
    assert sum(v[0] for v in got.values()) == 13 - 1
    assert out.where("kind = 'on time'").groupBy("start_ms").count().where("count > 1").count() == 0
