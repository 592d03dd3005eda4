"""Readers: explicit schemas, no inference; columns are pruned and filters pushed down by the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "user_id STRING, business_id STRING, date STRING, stars DOUBLE"
BUSINESS = "business_id STRING, city STRING, stars DOUBLE, review_count BIGINT, is_open INT, attributes MAP<STRING,STRING>"
TIP = "business_id STRING, user_id STRING, likes BIGINT"
CHECKIN = "business_id STRING, time MAP<STRING,BIGINT>"
USER = "user_id STRING, review_count BIGINT, average_stars DOUBLE, useful BIGINT, fans BIGINT"
RATINGS = "user_id STRING, business_id STRING, stars DOUBLE"
PAIRS = "user_id STRING, business_id STRING"


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def header_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; names come from the schema, by position."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True)


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """date, customer, product: columns 0, 1 and 5 of a quoted CSV with a header; embedded commas are kept."""
    raw = spark.read.csv(path, header=True, quote='"')
    c = raw.columns
    return raw.select(F.col(f"`{c[0]}`").alias("date"), F.col(f"`{c[1]}`").alias("customer"), F.col(f"`{c[5]}`").alias("product"))


def sampled_batches(lines: DataFrame, key: str, batches: int, size: int, seed: int = 553) -> DataFrame:
    """(batch, seq, key): `batches` draws of `size` lines each, uniformly with replacement, from counter-based hashes."""
    from ..plans.lineage import cut, numbered

    n_lines = cut(numbered(lines.select(key), [key], "_line"))
    total = n_lines.count()
    draws = lines.sparkSession.range(batches * size).select((F.col("id") / size).cast("long").alias("batch"), F.col("id").alias("seq"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)) + 1).alias("_line"))
    return draws.join(n_lines, "_line").select("batch", "seq", key)
