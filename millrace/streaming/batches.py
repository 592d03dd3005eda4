"""Structured Streaming wrappers: each micro-batch is appended to a table, over which the relational sketches run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sketch_stream(stream: DataFrame, state_path: str, checkpoint: str, sketch: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """Start a query on stream(user, ...) whose rows get (batch, seq); sink(sketch of all so far, batch) runs after each.

    Rows are written under their batch number, so a batch that is replayed replaces itself.
    """

    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = spark.read.parquet(state_path).where(F.col("batch") < batch).count() if batch else 0
        from ..plans.lineage import numbered

        rows = numbered(df, [c for c in ("ts", "event_id") if c in df.columns] or ["user"], "seq").withColumn("seq", F.col("seq") + before)
        rows.select("seq", "user").write.mode("overwrite").parquet(f"{state_path}/batch={batch}")
        sink(sketch(spark.read.parquet(state_path).where(F.col("batch") <= batch)), batch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def windowed_counts(stream: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window and key, closed by a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
