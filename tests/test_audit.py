"""The audit of all fields: tail probability, unexpected and missing values, skewed fields, one scan."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import vocab as V
from logloom.operators import audit
from logloom.sources.rows import with_log_fields


def test_chi_square_tail(spark):
    # Critical values of the usual tables.
    table = [(3.841459, 1, 0.05), (6.634897, 1, 0.01), (18.307038, 10, 0.05), (23.209251, 10, 0.01), (36.415029, 24, 0.05), (124.342113, 100, 0.05)]
    got = spark.createDataFrame(table, "x double, dof bigint, p double").select("p", audit.chi2_tail(F.col("x"), F.col("dof")).alias("got")).collect()
    assert all(r["got"] == pytest.approx(r["p"], abs=1e-7) for r in got)
    edge = spark.createDataFrame([(0.0, 3), (5000.0, 3), (1300.0, 255), (1e-9, 2)], "x double, dof bigint").select(audit.chi2_tail(F.col("x"), F.col("dof"))).collect()
    assert [r[0] for r in edge] == pytest.approx([1.0, 0.0, 0.0, 1.0], abs=1e-8)


@pytest.fixture(scope="module")
def rows(spark):
    ids = spark.range(0, 40_000, 1, 4).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    out = with_log_fields(ids, ["id"], "ts", 5, error_rate=0.3, fields=["method", "protocol", "service", "host", "referrer", "username", "status", "ip", "path", "user_agent"])
    from logloom.functions.draws import Draws
    from logloom.functions.fields import log_level

    return out.withColumn("level", log_level(Draws(["id"], 5)))


def test_drawn_fields_pass_and_a_skewed_one_fails(rows):
    fields = audit.audited(F.col("status"))
    got = audit.audit_fields(rows, fields, 5).select("field", "observed", "dof", "p_value").collect()
    p = {r["field"]: r["p_value"] for r in got}
    assert set(p) == {*audit.SLOT_FIELDS, *audit.POOL_FIELDS} and min(p.values()) > 1e-4
    total = {f: sum(r["observed"] for r in got if r["field"] == f) for f in p}
    assert total["success_status"] + total["client_status"] + total["server_status"] == total["host"] == 40_000
    skewed = rows.withColumn("host", F.when(F.col("id") % 10 == 0, V.HOSTS[0]).otherwise(F.col("host")))
    bad = {r["field"]: r["p_value"] for r in audit.audit_fields(skewed, fields, 5).collect()}
    assert bad["host"] < 1e-6 and bad["method"] == p["method"]


def test_odd_missing_null_and_no_values(spark):
    df = spark.createDataFrame([("HTTP/1.1",)] * 6 + [("HTTP/3",), (None,)], "v string")
    got = {r["value"]: r for r in audit.audit_fields(df, {"protocol": F.col("v")}).collect()}
    assert set(got) == {"HTTP/1.0", "HTTP/1.1", "HTTP/2.0", "HTTP/3"} and got["HTTP/1.0"]["observed"] == 0
    assert got["HTTP/3"]["chi2_term"] is None and {r["p_value"] for r in got.values()} == {0.0}
    assert got["HTTP/1.1"]["expected"] == 3.5 and got["HTTP/1.1"]["dof"] == 2
    none = audit.audit_fields(df.limit(0), {"protocol": F.col("v")}).collect()
    assert len(none) == 3 and all(r["observed"] == 0 and r["p_value"] == 1.0 for r in none)


def test_one_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet")
    plan = audit.audit_fields(df, {"host": F.col("p_brand"), "service": F.col("p_type")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
