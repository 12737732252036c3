"""Session helpers."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00", "UTC+00:00")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a folder of its own (tests).
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="logloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def require_utc() -> None:
    """Times are read and printed in UTC; another session zone would shift them silently."""
    spark = SparkSession.getActiveSession()
    zone = spark.conf.get("spark.sql.session.timeZone") if spark else "UTC"
    if zone not in UTC_NAMES:
        raise ValueError(f"set spark.sql.session.timeZone to UTC: it is {zone}")


HUGE_METHOD, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", 8_000


def split_long_methods(spark: SparkSession) -> None:
    """Leave a stage whose generated method the JVM would only interpret (beyond 8,000 bytes) to split projections.

    Spark's own limit is 65,535 bytes; a session that names one keeps it.
    """
    if spark.conf.get(HUGE_METHOD, None) is None:
        spark.conf.set(HUGE_METHOD, str(COMPILED_BYTES))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: later stages survive executor loss without replaying."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through Parquet files in the shared folder, removed when the application ends.

    Large tables take less disk than as a checkpoint, and are computed once; a checkpoint computes them twice.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
