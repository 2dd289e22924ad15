"""Session telemetry read from the event tables.

Event times are compressed (one hour of wall clock becomes one second of session time) so that the
five-second bins and ten-second gaps of session analytics apply to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators.ordering import running_sum, time_order

SESSION_DURATION_MS = 720_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event: ``event_id, session_id, t_ms, event_type, value, k``."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("session_id"),
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 3600").alias("t_ms"),
        "event_type",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
    )


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Signals with the cumulative counter ``c`` of each session."""
    rows = signals(spark, folder)
    order = time_order(rows)
    return order.untag(order.running(order.tag(rows), c=running_sum(F.col("k"))))


def noisy_counters(spark: SparkSession, folder: str) -> DataFrame:
    """The counter as read by an imperfect reader: some readings missing, some with a digit attached."""
    return counters(spark, folder).withColumn("raw", F.expr(
        "CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 37 = 0 THEN c * 10 ELSE c END"))


SIGNAL_SQL = """
sig AS (
  SELECT event_id, user_id AS session_id,
         date_diff('millisecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 3600 AS t_ms,
         event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events)"""

COUNTER_SQL = SIGNAL_SQL + """,
cnt AS (
  SELECT *, CAST(sum(k) OVER (PARTITION BY session_id ORDER BY t_ms, event_id) AS BIGINT) AS c FROM sig)"""

NOISY_SQL = COUNTER_SQL + """,
noisy AS (
  SELECT *, CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 37 = 0 THEN c * 10 ELSE c END AS raw FROM cnt)"""
