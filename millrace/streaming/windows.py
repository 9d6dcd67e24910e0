"""Windowed aggregation of streams: tumbling, sliding and session windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(stream: DataFrame, time: str, size: str, *aggs: Column, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = (), session: bool = False) -> DataFrame:
    """Aggregates by window and keys; rows later than ``late`` behind the newest are dropped. Works on tables too."""
    if stream.isStreaming:
        stream = stream.withWatermark(time, late)
    w = F.session_window(time, size) if session else F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.groupBy(w.alias("__w"), *by).agg(*aggs)
    return out.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[c for c in out.columns if c != "__w"])


def to_files(result: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append closed windows to Parquet, exactly once; without ``every`` all that is there now, then stop."""
    writer = result.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start(path)
