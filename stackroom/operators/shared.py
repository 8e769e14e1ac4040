"""Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir; one of our own only in local mode where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file:///tmp/checkpoints/stackroom"
    return f"{at.rstrip('/')}/stackroom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table as written to the shared folder and read again."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file of these bytes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """With a broadcast hint if the counted rows are within the bound; otherwise Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's place (from 1) in a total order, which ends in a unique column.

    Rows are range-partitioned, sorted and written once; places follow from the rows of the partitions before.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "placed")
    # as many rows as partitions
    each = cut.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    off = each.select("__part", (before - F.col("first") + 1).alias("__off"))
    return cut.join(F.broadcast(off), "__part").withColumn(name, F.col("__at") + F.col("__off")).drop("__part", "__at", "__off")
