"""The streaming operators over the event table, replayed as a stream of files in time order."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.plans.detection import _stops, detections
from sessionlake.plans.machine import COIN_SQL, coin_samples
from sessionlake.plans.registry import query
from sessionlake.session import ensure_checkpoint_dir
from sessionlake.sources.telemetry import SIGNAL_SQL, signals
from sessionlake.streaming import machines, windows

STRETCHES, FILES = 3, 4
END_MS = 10_000_000_000  # where the row stands that ends a replay


class Replay:
    """The rows of a table as a stream: three stretches of time, and one row of session -1 far ahead, so that the watermark passes all.

    The watermark's delay is a stretch, since the files of one are read in any order."""

    def __init__(self, spark: SparkSession, rows: DataFrame) -> None:
        ensure_checkpoint_dir(spark)
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
        first, last = rows.agg(F.min("t_ms"), F.max("t_ms")).first()
        first, last = first or 0, (last or 0) + 1
        self.stretch = max(1, -(-(last - first) // STRETCHES))
        self.watermark = f"{self.stretch} milliseconds"
        self.rows = rows
        for i in range(STRETCHES):
            low = first + i * self.stretch
            self.add(rows.filter((F.col("t_ms") >= low) & (F.col("t_ms") < low + self.stretch)))

    def add(self, rows: DataFrame) -> None:
        self._write(rows.repartition(FILES))

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/in")

    def end(self, at: int = END_MS) -> None:
        blank = {f.name: F.lit(None).cast(f.dataType) for f in self.rows.schema}
        ends = self.rows.sparkSession.range(0, FILES, 1, FILES)  # one in each file, so that they make a batch of their own
        self._write(ends.select(*(F.lit(-1 if n == "session_id" else at).cast(self.rows.schema[n].dataType).alias(n) if n in ("session_id", "t_ms") else c.alias(n) for n, c in blank.items())))

    def stream(self) -> DataFrame:
        return self.rows.sparkSession.readStream.schema(self.rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{self.folder}/in")


def drained(out: DataFrame, replay: Replay, name: str | None = None) -> DataFrame:
    """What the stream publishes until its input is used up."""
    folder = f"{replay.folder}/{uuid.uuid4().hex}"
    writer = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    query = (writer.queryName(name) if name else writer).start(f"{folder}/out")
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/out").filter("session_id >= 0")


def replayed(spark, rows):
    replay = Replay(spark, rows)
    replay.end()
    return replay, replay.stream()


@query("stream_coin_machine", COIN_SQL)
def stream_coin_machine(spark, folder):
    """The coin counter in event time; equal to the batch machine."""
    replay, stream = replayed(spark, coin_samples(spark, folder))
    with machines.state_store(spark):
        return drained(machines.run_machine(stream, machines.COIN, ["session_id"], ["event_id"], watermark=replay.watermark), replay)


@query("stream_tracks")
def stream_tracks(spark, folder):
    """Tracks of detections between interruptions, as a stream."""
    found, stops = detections(spark, folder), _stops(spark, folder)
    both = found.select("session_id", "code", "t_ms", "det_id", "x", "y", "score", F.lit(False).alias("stop")).unionByName(
        stops.select("session_id", "t_ms", F.lit(True).alias("stop")), allowMissingColumns=True)
    replay, stream = replayed(spark, both)
    with machines.state_store(spark):
        tracks = machines.track_stream(stream.filter("NOT stop"), stream.filter("stop OR session_id < 0"), reach=300.0, watermark=replay.watermark)
        return drained(tracks, replay).select("session_id", "code", "det_id", "track_id", "t_ms")


@query("stream_bins", f"""
WITH {SIGNAL_SQL} SELECT session_id, t_ms // 5000 * 5000 AS start_ms, t_ms // 5000 * 5000 + 5000 AS end_ms, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (k < 50) AS low FROM sig GROUP BY ALL""")
def stream_bins(spark, folder):
    replay, stream = replayed(spark, signals(spark, folder).select("session_id", "t_ms", "event_type", "k"))
    counts = {"purchases": F.col("event_type") == "purchase", "low": F.col("k") < 50}
    return drained(windows.binned_counts(windows.with_event_time(stream), counts, watermark=replay.watermark), replay)


@query("stream_gap_sessions", f"""
WITH {SIGNAL_SQL}, g AS (SELECT *, coalesce(t_ms - lag(t_ms) OVER w >= 20000, TRUE) AS fresh FROM sig WINDOW w AS (PARTITION BY session_id ORDER BY t_ms, event_id)),
n AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY session_id ORDER BY t_ms, event_id) AS run FROM g)
SELECT session_id, count(*) AS events, min(t_ms) AS start_ms, max(t_ms) AS last_ms FROM n GROUP BY session_id, run""")
def stream_gap_sessions(spark, folder):
    replay, stream = replayed(spark, signals(spark, folder).select("session_id", "t_ms", "event_id"))
    return drained(windows.gap_sessions(windows.with_event_time(stream), "20 seconds", ["session_id"], watermark=replay.watermark), replay)


@query("stream_trailing_mean", f"""
WITH {SIGNAL_SQL}, w AS (SELECT session_id, (t_ms // 5000 + i + 1) * 5000 AS end_ms, k FROM sig, range(0, 6) r(i))
SELECT session_id, end_ms, round(avg(k), 6) AS mean, count(k) AS n FROM w GROUP BY ALL""")
def stream_trailing_mean(spark, folder):
    replay, stream = replayed(spark, signals(spark, folder).select("session_id", "t_ms", "k"))
    return drained(windows.trailing_mean(windows.with_event_time(stream), "k", watermark=replay.watermark), replay).withColumn("mean", F.round("mean", 6))


@query("stream_distinct_events", f"""
WITH {SIGNAL_SQL} SELECT session_id, event_id, t_ms FROM sig""")
def stream_distinct_events(spark, folder):
    """Every event is delivered twice and kept once."""
    rows = signals(spark, folder).select("session_id", "event_id", "t_ms")
    replay, stream = replayed(spark, rows.unionAll(rows))
    return drained(windows.distinct_events(windows.with_event_time(stream), ["session_id", "event_id"], watermark=replay.watermark).drop("event_time"), replay)


@query("stream_late_rows", f"""
WITH {SIGNAL_SQL} SELECT 'late_rows' AS stream, count(*) + count(*) FILTER (event_id % 10 = 3) + 8 AS arrived, count(*) FILTER (event_id % 10 = 3) AS late FROM sig""")
def stream_late_rows(spark, folder):
    """One event in ten comes again when the watermark has long passed: the machine refuses it, and a listener counts it."""
    rows = coin_samples(spark, folder)
    replay = Replay(spark, rows)
    replay.end()
    replay.add(rows.filter("event_id % 10 = 3"))
    replay.end(2 * END_MS)
    name = f"late_{uuid.uuid4().hex}"
    listener = machines.LateRows()
    spark.streams.addListener(listener)
    try:
        with machines.state_store(spark):
            drained(machines.run_machine(machines.LateRows.watch(replay.stream()), machines.COIN, ["session_id"], ["event_id"], watermark=replay.watermark), replay, name)
        for _ in range(100):  # events reach a listener shortly after the stream has ended
            if listener.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([("late_rows", listener.arrived[name], listener.late[name])], "stream string, arrived long, late long")
