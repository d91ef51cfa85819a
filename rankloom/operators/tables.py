"""Intermediate results that are written once, and rows numbered in order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, that in ``spark.checkpoint.dir``.

    A session on one machine that names none gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rankloom-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it back, which cuts its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared checkpoint folder and reads it back: smaller than a checkpoint of many rows, but in other partitions.

    Shuffle files of what went into it are of no more use, so Spark is asked to remove them right after the write.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... in ``order``, columns that leave no ties.

    Rows are dealt by ranges of the order, each range is numbered by itself and starts where the ranges before it end. So only
    one row for each range meets in one task.
    """
    dealt = checkpointed(df.repartitionByRange(*order)).withColumn("_range", F.spark_partition_id())
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_range").alias("_r"), before.alias("_start"))
    inner = dealt.withColumn("_inner", F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1)
    return inner.join(starts, F.col("_range") == F.col("_r")).withColumn(out, F.col("_start") + F.col("_inner")).drop("_range", "_r", "_start", "_inner")


def running_sum(df: DataFrame, order: Sequence, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows up to this one in ``order``, columns that leave no ties; dealt by ranges like ``numbered``."""
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("_range").alias("_r"), before.alias("_start"))
    inner = dealt.withColumn("_inner", F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return inner.join(starts, F.col("_range") == F.col("_r")).withColumn(out, F.col("_start") + F.coalesce("_inner", F.lit(0))).drop("_range", "_r", "_start", "_inner")
