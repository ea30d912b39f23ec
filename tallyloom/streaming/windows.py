"""Windowed counts over a stream: the streaming form of the exploration counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``(start, key, n)`` per tumbling window of event time. Events later than the watermark ``late`` are dropped by the
    engine, which bounds its state to the open windows; null keys are left out. Works on a static table as well."""
    rows = events.where(F.col(key).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counts = rows.groupBy(F.window("_ts", width), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def top_per_window(counts: DataFrame, key: str, k: int) -> DataFrame:
    """``(start, key, n)``: the ``k`` most frequent keys of each window, ties to the smaller key. For a batch, as within
    ``foreachBatch`` over :func:`windowed_counts`."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("n"), key))
    return counts.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
