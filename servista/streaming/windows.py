"""Windowed counts of a stream: state up to a watermark, each window written once when it can no longer change."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, moment: str, width: str = "1 hour", delay: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """window_start, window_end, by and n of a stream; rows whose window ended before the watermark, `delay` behind the latest row, are dropped."""
    counts = stream.withWatermark(moment, delay).groupBy(F.window(moment, width).alias("w"), *(by or [])).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []), "n")


def follow_counts(counts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the windows that are over to a Parquet folder, for all that the stream has now; open ones stay in the state."""
    return counts.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
