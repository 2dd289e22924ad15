"""Health events with nested evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.operators import health as ops
from sessionlake.plans.registry import query
from sessionlake.plans.source import _text_sql
from sessionlake.sources.files import table_fingerprint
from sessionlake.sources.telemetry import SIGNAL_SQL, signals, table


def observations(spark, folder):
    return signals(spark, folder).filter("event_type = 'view'").select("session_id", "event_id", "t_ms", "k")


def health_events(spark, folder):
    """Clicks of sessions that were observed as health events; every seventh has no evidence, every ninth broken attributes."""
    k, e = F.col("k"), F.col("event_id")
    details = F.struct((k * 1.0).alias("previous_percent"), F.when(e % 5 != 0, k - 3.5).alias("current_percent"))
    evidence = F.when(e % 7 != 0, F.to_json(F.array(F.struct(F.lit("bar").alias("source"), details.alias("details")), F.struct(F.lit("overlay").alias("source"), F.struct(F.lit(0.0).alias("previous_percent"), F.lit(None).cast("double").alias("current_percent")).alias("details")))))
    attributes = F.when(e % 9 == 0, "{broken").when(e % 4 == 0, F.to_json(F.struct(F.lit("none").alias("attribution")))).otherwise(
        F.to_json(F.struct(F.struct(F.concat(F.lit("item_"), (k % 6).cast("string")).alias("item"), k.alias("n")).alias("attribution"))))
    seen = observations(spark, folder).select("session_id").distinct()
    return signals(spark, folder).filter("event_type = 'click'").join(seen, "session_id", "left_semi").select(
        "session_id", "event_id", F.lit("health_decreased").alias("event_type"), F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 500).alias("end_ms"), F.col("t_ms").alias("anchor_ms"), k.alias("quantity"),
        F.when(k < 50, "A").otherwise("B").alias("evidence_grade"), evidence.alias("evidence"), attributes.alias("attributes"))


@query("health_payload", f"""
WITH {SIGNAL_SQL}, h AS (SELECT session_id, CAST(sum(CAST('0x' || substr(sha256({_text_sql('session_id', 'event_id', 't_ms', 'k')}), 1, 15) AS BIGINT)) AS VARCHAR) AS provenance FROM sig WHERE event_type = 'view' GROUP BY session_id),
v AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN json_array(json_object('source', 'bar', 'details', json_object('previous_percent', k * 1.0, 'current_percent', CASE WHEN event_id % 5 <> 0 THEN k - 3.5 END)), json_object('source', 'overlay')) END AS evidence,
  CASE WHEN event_id % 9 = 0 THEN '{{broken' WHEN event_id % 4 = 0 THEN '{{"attribution":"none"}}' ELSE CAST(json_object('attribution', json_object('item', 'item_' || (k % 6), 'n', k)) AS VARCHAR) END AS attributes FROM sig WHERE event_type = 'click')
SELECT v.session_id, event_id, 'health_decreased' AS event_type, t_ms AS start_ms, t_ms + 500 AS end_ms, t_ms AS media_time_ms, k AS quantity, CASE WHEN k < 50 THEN 'A' ELSE 'B' END AS evidence_grade,
  CAST(json_extract_string(evidence, '$[0].details.previous_percent') AS DOUBLE) AS previous_percent, CAST(json_extract_string(evidence, '$[0].details.current_percent') AS DOUBLE) AS current_percent,
  CASE WHEN json_valid(attributes) THEN json_extract_string(attributes, '$.attribution.item') END AS attribution, CAST(coalesce(json_array_length(evidence), 0) AS INTEGER) AS evidence_rows, provenance FROM v JOIN h USING (session_id)""")
def health_payload(spark, folder):
    seen = observations(spark, folder)
    return ops.health_payload(health_events(spark, folder), seen, table_fingerprint(seen, ["session_id"]))


@query("props_values", """
WITH p AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, count(*) AS rows, count(k) AS valued, CAST(sum(k) AS BIGINT) AS total, max(k) AS largest FROM p GROUP BY event_type""")
def props_values(spark, folder):
    """The value inside each event's JSON properties, read as a variant."""
    k = ops.json_value(F.col("props"), "$.k", "bigint")
    return table(spark, folder, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count("k").alias("valued"), F.sum("k").alias("total"), F.max("k").alias("largest"))
