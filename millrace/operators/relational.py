"""Counts, top-k, averages, default fills and partition reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def count_keys(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Distinct values of key; null counts as one."""
    return df.agg((F.countDistinct(key) + F.max(F.col(key).isNull().cast("long"))).alias(name)) if df.schema[key].nullable else df.agg(F.countDistinct(key).alias(name))


def top_keys(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent keys by (count descending, key ascending); a heap a task, no full sort."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def grouped_average(facts: DataFrame, dim: DataFrame, on: str, by: str, value: str) -> DataFrame:
    """Average of value by the dimension's column `by`, largest first; the join's strategy is the optimizer's."""
    return facts.join(dim, on).groupBy(by).agg(F.round(F.avg(value), 6).alias("avg_value")).orderBy(F.desc("avg_value"), by)


def left_with_default(left: DataFrame, right: DataFrame, on: str, value: str, default) -> DataFrame:
    return left.join(right, on, "left").withColumn(value, F.coalesce(value, default))


def known(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "left_semi")


def unknown(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "left_anti")


def first_letter_partitions(df: DataFrame, key: str, n: int) -> DataFrame:
    """(partition, n_items), empty ones included, as a partitioner by the first character's code point would deal them."""
    counts = df.groupBy(F.pmod(F.ascii(key), F.lit(n)).alias("partition")).agg(F.count("*").alias("n_items"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition")).join(counts, "partition", "left").select("partition", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def layout(df: DataFrame) -> DataFrame:
    """(partition, n_items) of df as it is dealt now, empty partitions included."""
    n = df.rdd.getNumPartitions()
    counts = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition")).join(counts, "partition", "left").fillna(0)


def repartition_by_first_letter(df: DataFrame, key: str, n: int) -> DataFrame:
    """Deal rows to n partitions by the code point of the key's first character modulo n."""
    return df.repartitionById(n, F.pmod(F.ascii(key), F.lit(n)))


def review_stats(reviews: DataFrame, year: int, user: str = "user_id", item: str = "business_id", date: str = "date") -> DataFrame:
    """The statistics report as one row."""
    base = reviews.agg(F.count("*").alias("n_review"), F.count_if(F.substring(date, 1, 4) == str(year)).alias(f"n_review_{year}"), F.countDistinct(user).alias("n_user"), F.countDistinct(item).alias("n_business"))
    for c, name in ((user, "top10_user"), (item, "top10_business")):
        top = top_keys(reviews, c).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(c).alias("id")))).alias(name))
        base = base.crossJoin(F.broadcast(top.select(F.transform(name, lambda x: F.struct(x["id"].alias("id"), (-x["n"]).alias("n"))).alias(name))))  # one row each
    return base
