"""Helpers of the training-data operators: staged tables, ranks, word patterns."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.session import ensure_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def in_training(doc_id: Column) -> Column:
    """Four fifths of the documents by checksum of the id; the rest are held out (null ids too)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0, F.lit(False))


def global_rank(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``: the place (from 0) of each row in ascending order of the unique ``key``.

    Rows are range partitioned; only one count per partition is looked at across partitions, so
    the broadcast side has at most ``spark.sql.shuffle.partitions`` rows.
    """
    spread = df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id())
    spread = staged(spread, "rank")
    inside = Window.partitionBy("_part").orderBy(key)
    across = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    ranked = spread.withColumn(name, F.row_number().over(inside) - 1).join(F.broadcast(before), "_part")
    return ranked.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
