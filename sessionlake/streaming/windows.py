"""Streaming windows: bins, trailing means, gap sessions and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# session time 0 lies one day after the epoch: a stream's first watermark is the epoch, and rows at it would count as late
ORIGIN_MS = 86_400_000


def with_event_time(df: DataFrame, time_ms: str = "t_ms", name: str = "event_time") -> DataFrame:
    return df.withColumn(name, F.timestamp_millis(F.col(time_ms) + ORIGIN_MS))


def session_ms(column: str) -> Column:
    return F.unix_millis(column) - ORIGIN_MS


def binned_counts(stream: DataFrame, counts: dict[str, Column], *, watermark: str = "30 seconds", width: str = "5 seconds", key: str = "session_id") -> DataFrame:
    """Half-open tumbling bins; a bin is emitted once the watermark has passed its end."""
    w = F.window("event_time", width)
    d = stream.withWatermark("event_time", watermark).groupBy(key, w.alias("w")).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    return d.select(key, session_ms("w.start").alias("start_ms"), session_ms("w.end").alias("end_ms"), *counts)


def trailing_mean(stream: DataFrame, value: str, *, watermark: str = "30 seconds", width: str = "30 seconds", slide: str = "5 seconds", key: str = "session_id") -> DataFrame:
    """Mean over the trailing window; a centred one would need rows that have not arrived yet."""
    w = F.window("event_time", width, slide)
    d = stream.withWatermark("event_time", watermark).groupBy(key, w.alias("w")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return d.select(key, session_ms("w.end").alias("end_ms"), "mean", "n")


def gap_sessions(stream: DataFrame, gap: str, keys: Sequence[str], *, watermark: str = "30 seconds") -> DataFrame:
    """Runs of events that follow each other in less than the gap; Spark's session window also joins events a whole gap apart."""
    w = F.session_window("event_time", f"{gap} -1 microseconds")
    d = stream.withWatermark("event_time", watermark).groupBy(*keys, w.alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("last_ms"))
    return d.drop("w")


def distinct_events(stream: DataFrame, keys: Sequence[str], *, watermark: str = "30 seconds") -> DataFrame:
    """First copy of each event among those that arrive within the watermark."""
    return stream.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(list(keys))
