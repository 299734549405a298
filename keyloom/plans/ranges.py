"""Orders over a whole table, or over keys of any size, that no single task has to hold."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that is unset, a temporary folder does if Spark runs in one process; on a cluster it is an error.
    """
    kept = spark.conf.get("spark.checkpoint.dir", None)
    if not kept:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        kept = tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", kept)
    return f"{kept.rstrip('/')}/keyloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def total_order(df: DataFrame, order: list, value: str | None = None) -> DataFrame:
    """Add ``ix``, the place from 0 in the order by ``order``, and ``upto``, the sum of ``value`` so far.

    A range partitioning sorts, so equal leading values don't meet in one task if later ones differ.  The
    sorted rows are written once, as places must not change when a task is run again; then only a count
    and a sum for each partition cross partitions.
    """
    path = shared_path(df.sparkSession)
    put = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    put.write.parquet(path)
    put = df.sparkSession.read.schema(put.schema).parquet(path).withColumn("__part", F.shiftright("__m", 33))
    amount = F.col(value) if value else F.lit(0)
    sizes = put.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum(amount).cast("bigint").alias("s")).collect()
    starts, n, s = [], 0, 0
    for r in sorted(sizes):
        starts.append((r["__part"], n, s))
        n, s = n + r.n, s + (r.s or 0)
    starts = df.sparkSession.createDataFrame(starts, "__part bigint, __n bigint, __s bigint")
    run = Window.partitionBy("__part").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    put = put.join(F.broadcast(starts), "__part")  # a row for each partition
    put = put.withColumn("ix", F.col("__n") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    put = put.withColumn("upto", F.col("__s") + F.coalesce(F.sum(amount).over(run), F.lit(0)))
    return put.drop("__m", "__part", "__n", "__s")


def rank_in_keys(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Add ``rank`` from 0 inside each key, without a task for a whole key: one key may hold most rows."""
    placed = total_order(df, [*keys, *order])
    first = placed.groupBy(*keys).agg(F.min("ix").alias("__first"))
    return placed.join(first, keys).withColumn("rank", F.col("ix") - F.col("__first")).drop("ix", "upto", "__first")
