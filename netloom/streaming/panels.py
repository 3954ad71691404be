"""Panels from event streams: watermarked window sums that feed the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def streaming_panel(events: DataFrame, time: str, entity: str, value: str, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(t, entity, value): sums of a stream by entity and window; events later than ``late`` are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    sums = events.withWatermark(time, late).groupBy(window.alias("w"), F.col(entity).alias("entity")).agg(F.sum(value).alias("value"))
    return sums.select(F.col("w.start").alias("t"), "entity", "value")


def write_panel(panel: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append closed windows to Parquet, exactly once by the checkpoint."""
    writer = panel.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
