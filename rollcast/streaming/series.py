"""Hourly series from a stream of events: what `sources.series.hourly_events` makes of a table,
kept up to date. Rolling scores need whole windows of rows, so they read the table that
this stream appends to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.series import hour_index


def hourly(events: DataFrame, ts: str = "ts", value: str = "value", key: str | None = None, late: str = "2 hours") -> DataFrame:
    """(series_id, h, y, n) by tumbling hour of a stream of events; an hour is final when the
    watermark, `late` behind the newest event, has passed its end. Later events are
    dropped, so state holds the open hours only."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    series = F.lit("all") if key is None else F.coalesce(F.col(key).cast("string"), F.lit(""))
    d = e.groupBy(series.alias("series_id"), F.window("__ts", "1 hour").alias("w")).agg(F.sum(value).alias("y"), F.count(F.lit(1)).alias("n"))
    return d.select("series_id", hour_index(F.col("w.start")).alias("h"), "y", "n")


def append(series: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends final hours as Parquet until the source is read to its end."""
    return series.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
