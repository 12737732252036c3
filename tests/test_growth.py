"""Steps that made their rows several times, or drew what nobody reads."""

from pyspark.sql import functions as F

from logloom.operators import metrics
from logloom.operators.formats import FORMAT_FIELDS, render
from logloom.plans import fixtures as X
from logloom.plans import output_queries as Q
from logloom.sources.rows import with_log_fields


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partition_payloads_are_packed_once(spark, sf):
    assert plan_of(Q.k7_partition(spark, sf)).count("MapInArrow") == 1


def test_a_row_draws_only_what_its_format_reads(spark, sf):
    src = X.table(spark, sf, "lineitem").select(*X.LINE_KEYS, F.col("l_shipdate").alias("ts")).limit(500)
    src = src.withColumn("fmt", Q.mixed_format(F.col("l_linenumber") + F.col("l_orderkey"))).persist()
    fields = Q._fields_of(Q.MIXED)
    for digest in ("md5", "xxhash64"):
        whole = with_log_fields(src, X.LINE_KEYS, "ts", 3, digest, error_rate=0.4, fields=fields)
        own = with_log_fields(src, X.LINE_KEYS, "ts", 3, digest, error_rate=0.4, fields=fields, fmt=F.col("fmt"), formats=Q.MIXED)
        keep = [*X.LINE_KEYS, "fmt", "line"]
        lines = [sorted(map(tuple, render(df, F.col("fmt"), formats=Q.MIXED).select(*keep).collect())) for df in (whole, own)]
        assert lines[0] == lines[1] and all(row[-1] for row in lines[0])
        for row in own.collect():
            assert all((row[f] is not None) == (f in FORMAT_FIELDS[row["fmt"]]) for f in fields)


def test_requests_are_read_once(spark, sf):
    from logloom.plans.scenario_queries import request_texts
    from logloom.sources.requests import expand_requests

    got = expand_requests(request_texts(spark, sf), "json", "request_id")
    for table in (got["control"].meta, got["control"].timeline, got["outputs"], got["rejected"]):
        assert "Python" not in plan_of(table) and "InPandas" not in plan_of(table)


def test_dense_reports_make_their_rows_once(spark):
    rows = spark.range(0, 100, 7).select(F.timestamp_millis(F.col("id") * 1000).alias("ts"), F.col("id").alias("n_bytes"), F.lit(False).alias("bad"))
    out = metrics.running_totals(metrics.throughput(rows, "ts", error=F.col("bad"), dense=True), block=16)
    assert "Range" not in plan_of(out)
    assert out.agg(F.count("*"), F.sum("logs"), F.max("total_logs"), F.sum("bytes")).first() == (197, 15, 15, 735)


def test_planned_rows_carry_the_states_of_their_bucket(spark, sf):
    """The same rows whether states are broadcast, carried with the plan or merged in time order."""
    from logloom.operators import attach, run
    from logloom.operators.states import state_intervals
    from logloom.plans import run_queries as R

    control = R.run_control(spark, sf)
    intervals = state_intervals(control, X.SEED, X.DIGEST).persist()
    keep = [*run.RUN_KEYS, "t_ms", "lps", "error_fp", "spike_active", "line", "is_error", "status"]

    def rows(**kw):
        states = attach.States(intervals, literal_rows=0, **kw)
        out = run.run_rows(control, X.CUSTOMER_ORIGIN, X.SEED, X.DIGEST, R.BUCKET, states=states).select(*keep)
        plan = spark.range(1).select(F.lit("x").alias("scenario_id"), F.lit(0).alias("bucket"))
        return sorted(map(tuple, out.collect())), states.in_buckets(plan, R.BUCKET)[1]

    broadcast, carried = rows(), rows(broadcast_rows=0)
    assert broadcast[1] == [] and carried[1] == [attach.CARRIED] and broadcast[0] and broadcast[0] == carried[0]


def test_truth_buckets_are_made_once(spark, sf):
    from logloom.plans.scenario_queries import g1_buckets

    plan = plan_of(g1_buckets(spark, sf))
    assert plan.count("FileScan") == 2  # spikes and clocks
    above = plan[: plan.index("Generate")]
    assert not any(step in above for step in ("Exchange", "Join", "Sort", "Window", "HashAggregate"))
    assert plan.count("md5(") == 2  # the two parts of one jitter
