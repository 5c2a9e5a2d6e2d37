"""The ordered vote on a stream: per item and event-time window, late rows dropped behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, item: str, value: str, ts: str, pos: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), F.col(item).alias("item"), F.col(value).alias("value"))
    return w.agg(F.count("*").alias("k"), F.min(pos).alias("p"))


def winners_stream(counts: DataFrame, width: str = "1 hour") -> DataFrame:
    """The vote of each window and item as a stream, in append mode: a second aggregate over the windows of the counts,
    which gives a window's winner once, when the watermark has passed its end. State: one row a window, item and
    value, then one a window and item; both go with the watermark."""
    w = counts.groupBy(F.window(F.window_time("window"), width).alias("window"), "item")
    return w.agg(F.max_by("value", F.struct("k", (-F.col("p")).alias("q"))).alias("value"), F.sum("k").alias("n"))


def winners(counts: DataFrame) -> DataFrame:
    """The vote of each window's counts; for batches, as in foreachBatch."""
    return counts.groupBy("window", "item").agg(F.max_by("value", F.struct("k", (-F.col("p")).alias("q"))).alias("value"), F.sum("k").alias("n"))
