"""Cutting lineage, and numbering rows without one global sort task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Spark deletes a query's shuffle files when it ends, not when the driver's heap is next collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark) -> str:
    """The folder of spark.checkpoint.dir; unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of spark.checkpoint.dir; unset, in a temporary one in local mode only."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, written one after the other as one Parquet table beside the checkpoints.

    Unlike cut(), the table is compressed, and the shuffle files of a part go when it is written.
    """
    spark = parts[0].sparkSession
    path = f"{_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        for p in parts:
            p.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(parts[0].schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str = "seq") -> DataFrame:
    """Number rows from 1 in the order given: a range-partitioned sort, and offsets from the partitions' counts."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    first = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    first = first.select("_part", "_low", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(first), "_part").withColumn(name, F.col("_id") - F.col("_low") + F.col("_before") + 1).drop("_part", "_id", "_low", "_before")


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Number the rows of each group from 1 in the order given, as a window would, but with no group in one task.

    A range-partitioned sort may cut a group anywhere; offsets come from a count
    for each group and partition.
    """
    n, keys = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*group, *order]
    s = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    s = stored(s.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    runs = s.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition that has rows of the group
    runs = runs.select(*group, "_part", (F.coalesce(before, F.lit(0)) + 1 - F.col("_low")).alias("_shift"))
    return s.join(runs, [*group, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of `value` up to each row in the order given, and the row's place `seq` from 1: sums within sorted partitions, and those of the partitions before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = s.withColumn(name, F.sum(value).over(w)).withColumn("seq", F.count("*").over(w))
    past = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = s.groupBy("_part").agg(F.sum(value).alias("_v"), F.count("*").alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_v").over(past), F.lit(0)).alias("_v"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_n"))
    return own.join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_v")).withColumn("seq", F.col("seq") + F.col("_n")).drop("_part", "_v", "_n")
