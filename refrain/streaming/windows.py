"""Event-time aggregates over streams or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str, late: str | None = None, time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, by, n, total) of tumbling windows; on a stream, rows later than ``late`` are left out."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if late and events.isStreaming:
        rows = rows.withWatermark(time, late)
    out = rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")
