"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm the JVM and then three times; the median counts.
Stateless pipelines are built once and executed per run, as a long job would;
the scenario queries include building and materialising their state tables.
``throughput`` gives rows/s and MB/s of the five formatters into the noop sink,
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from logloom.operators import metrics, payloads
    from logloom.operators.attach import States, attach_scenario, inject_anomalies
    from logloom.operators.formats import FORMAT_FIELDS, render
    from logloom.operators.parse import parse_lines
    from logloom.operators.sinks import discard
    from logloom.plans import fixtures as Z
    from logloom.plans import scenario_queries
    from logloom.sources.rows import generate_rows, with_log_fields

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("logloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seed = Z.SEED
    lines = Z.table(spark, SF_DIR, "lineitem").select(*Z.LINE_KEYS, F.col("l_shipdate").alias("ts"))
    # The test file is one row group, which is one scan task; a cluster reads many.
    lines = lines.repartition(CPUS, *Z.LINE_KEYS)
    events = Z.table(spark, SF_DIR, "events")

    def rendered(fmt: str):
        return render(with_log_fields(lines, Z.LINE_KEYS, "ts", seed, fields=FORMAT_FIELDS[fmt]), fmt)

    def month():
        return States.of(Z.month_control(spark), seed)

    def month_errors():
        rows = attach_scenario(events, month(), "ts", Z.MONTH_ORIGIN)
        rows = inject_anomalies(rows, Z.EVENT_KEYS, seed)
        rows.groupBy("event_type", "spike_active").agg(F.count("*"), F.sum(F.col("is_error").cast("int"))).collect()

    def customers():
        return States.of(Z.customer_control(spark, SF_DIR), seed)

    def customer_attach():
        rows = Z.customer_rows(spark, SF_DIR).repartition(CPUS, *Z.LINE_KEYS)
        rows = attach_scenario(rows, customers(), "l_shipdate", Z.CUSTOMER_ORIGIN, "custkey")
        discard(rows)

    lines_of = {fmt: rendered(fmt) for fmt in FORMAT_FIELDS}
    ready = {f"render_{fmt}": df.select("line") for fmt, df in lines_of.items()}
    ready |= {
        "pack_partitions": payloads.pack_payloads(lines_of["apache"], "apache"),
        "pack_keyed": payloads.pack_payloads(lines_of["apache"], "apache", 1 << 20, Z.LINE_KEYS, CPUS),
        "throughput_hourly": metrics.throughput(lines_of["json"], "ts", 3_600_000),
        "parse_apache": parse_lines(lines_of["apache"].select("line"), "apache"),
    }
    queries = {name: (lambda df=df: discard(df)) for name, df in ready.items()}
    queries |= {
        "month_error_mix": month_errors,
        "customer_states_and_attach": customer_attach,
        "customer_row_budget": lambda: discard(
            generate_rows(scenario_queries.customer_budget(spark, SF_DIR), scenario_queries.BUCKET, Z.CUSTOMER_ORIGIN)
        ),
    }
    times, only = {}, set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    for name, run in queries.items():
        if only and name not in only:
            continue
        run()
        laps = []
        for _ in range(RUNS):
            started = time.perf_counter()
            run()
            laps.append(time.perf_counter() - started)
        times[name] = round(statistics.median(laps), 3)
    rate = {}
    for fmt in FORMAT_FIELDS:
        if f"render_{fmt}" in times:
            total = lines_of[fmt].agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).first()
            seconds = times[f"render_{fmt}"]
            rate[fmt] = {"rows_per_s": round(total["n"] / seconds), "mb_per_s": round(total["b"] / seconds / 1e6, 1)}
    print(
        json.dumps(
            {
                "metric": "headline queries, median of runs, summed",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "throughput": rate,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
