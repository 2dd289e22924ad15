"""Acceptance machines over noisy counters and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.operators import counters as counter_ops, machines as ops
from sessionlake.operators.ordering import time_order
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import COUNTER_SQL, SIGNAL_SQL, counters, signals


def readings(spark, folder):
    """Several readings of the counter per ten-second step, some with stray digits, some unreadable."""
    e = F.col("event_id")
    text = (F.when(e % 9 == 0, F.concat(F.col("c").cast("string"), F.lit("0"))).when(e % 11 == 0, F.concat(F.lit("7"), F.col("c").cast("string")))
            .when(e % 13 == 0, "skull").otherwise(F.col("c").cast("string")))
    return counters(spark, folder).select(
        "session_id", "event_id", "t_ms", F.expr("t_ms div 10000").alias("second"), (e % 3).alias("sample"), text.alias("text"), (e * 37 % 100 / 100.0).alias("confidence"),
        ((F.col("event_type") == "error") & (F.col("k") < 20)).alias("excluded"), "c")


def _seconds(spark, folder):
    return ops.distinct_readings(readings(spark, folder), "session_id", "second", sample="sample", text="text", confidence="confidence", excluded="excluded", tie="event_id")


@query("kill_select")
def kill_select(spark, folder):
    return ops.selected_counter(_seconds(spark, folder), "session_id", "second")


@query("kill_sequence")
def kill_sequence(spark, folder):
    return ops.selected_sequence(_seconds(spark, folder), "session_id", "second")


@query("kill_reconciliation")
def kill_reconciliation(spark, folder):
    """Seconds whose published value the sequence rule changes."""
    seconds = _seconds(spark, folder)
    return ops.changed_selections(ops.selected_counter(seconds, "session_id", "second"), ops.selected_sequence(seconds, "session_id", "second"), ["session_id", "second"])


@query("kill_plausible", f"""
WITH RECURSIVE {COUNTER_SQL}, s AS (SELECT session_id, t_ms // 10000 AS second, CASE WHEN event_id % 7 = 0 THEN c * 3 WHEN event_id % 13 = 0 THEN NULL ELSE c END AS v, (event_id * 37 % 100) / 100.0 AS conf, event_id FROM cnt),
g AS (SELECT session_id, second, list(v ORDER BY v) FILTER (v IS NOT NULL) AS vs, row_number() OVER (PARTITION BY session_id ORDER BY second) AS i FROM s GROUP BY session_id, second),
r AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS second, CAST(0 AS BIGINT) AS val, FALSE AS seen FROM (SELECT DISTINCT session_id FROM s)
  UNION ALL SELECT g.session_id, g.i, g.second, coalesce(ok[len(ok) // 2 + 1], val), len(ok) > 0 FROM (SELECT g.*, r.val, list_filter(coalesce(g.vs, []), lambda x: x >= r.val AND (r.val <= 10 OR x - r.val <= greatest(75, CAST(floor(r.val * 0.15) AS BIGINT)))) AS ok FROM r JOIN g ON g.session_id = r.session_id AND g.i = r.i + 1) g)
SELECT r.session_id, r.second, r.val AS kill_value, CASE WHEN seen THEN (SELECT arg_min(conf, event_id) FROM s WHERE s.session_id = r.session_id AND s.second = r.second AND s.v = r.val) ELSE 0.0 END AS confidence,
  CASE WHEN seen THEN 'observed' ELSE 'carried_forward' END AS source FROM r WHERE i > 0""")
def kill_plausible(spark, folder):
    rows = counters(spark, folder).select(
        "session_id", "event_id", F.expr("t_ms div 10000").alias("second"), F.expr("CASE WHEN event_id % 7 = 0 THEN c * 3 WHEN event_id % 13 = 0 THEN NULL ELSE c END").alias("v"),
        (F.col("event_id") * 37 % 100 / 100.0).alias("confidence"))
    return counter_ops.plausible_counter(rows, "session_id", "second", "v", "confidence", "event_id")


def coin_samples(spark, folder):
    k, e = F.col("k"), F.col("event_id")
    base = F.expr("t_ms div 20000 * 50")
    value = (F.when(k % 17 == 0, None).when(k % 13 == 0, base * 10 + 3).when(k % 11 == 0, base + 7_000).when(k % 7 == 0, base - 20).otherwise(base))
    # samples half a second apart, so that repeats can confirm each other
    return signals(spark, folder).select("session_id", "event_id", F.expr("t_ms div 15").alias("t_ms"), ((F.col("event_type") == "error") & (k < 25)).alias("paused"),
                                         (F.expr("t_ms div 60000") % 4 == 0).alias("fever"), value.cast("long").alias("candidate"), (0.9 + k % 10 / 100.0).alias("confidence"))


# independent of the step: digits are compared as texts, every case by its own rule
COIN_SQL = f"""
WITH RECURSIVE {SIGNAL_SQL},
s AS (SELECT session_id, event_id, t_ms // 15 AS t, event_type = 'error' AND k < 25 AS paused, t_ms // 60000 % 4 = 0 AS fever, k % 10 >= 5 AS sure,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 13 = 0 THEN t_ms // 20000 * 500 + 3 WHEN k % 11 = 0 THEN t_ms // 20000 * 50 + 7000 WHEN k % 7 = 0 THEN t_ms // 20000 * 50 - 20 ELSE t_ms // 20000 * 50 END AS c FROM sig),
o AS (SELECT *, CAST(c AS VARCHAR) AS ct, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS i FROM s),
r AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS t, CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS shown, CAST(NULL AS VARCHAR) AS reason,
    CAST(NULL AS BIGINT) AS val, CAST(NULL AS BIGINT) AS wv, CAST(NULL AS BIGINT) AS wt, CAST(NULL AS BIGINT) AS sv, CAST(NULL AS BIGINT) AS st FROM (SELECT DISTINCT session_id FROM s)
  UNION ALL SELECT session_id, i, event_id, t, c, CASE WHEN ok THEN c WHEN kind IN ('same', 'stray') THEN val END,
    CASE kind WHEN 'paused' THEN 'excluded_from_gameplay' WHEN 'fall' THEN 'counter_decrease_rejected' WHEN 'stray' THEN 'leading_digit_ocr_artifact_removed_from_confirmed_counter'
      WHEN 'leap' THEN 'implausible_counter_jump_rejected' WHEN 'noise' THEN 'gold_fever_counter_candidate_rejected'
      WHEN 'surge' THEN CASE WHEN ok THEN 'gold_fever_monotonic_confirmation' ELSE 'gold_fever_counter_awaiting_monotonic_confirmation' END
      WHEN 'rise' THEN CASE WHEN ok THEN NULL ELSE 'counter_change_awaiting_repeat_confirmation' END END,
    CASE WHEN ok THEN c ELSE val END,
    CASE WHEN kind IN ('paused', 'same', 'stray') OR ok THEN NULL WHEN kind = 'rise' THEN c ELSE wv END, CASE WHEN kind IN ('paused', 'same', 'stray') OR ok THEN NULL WHEN kind = 'rise' THEN t ELSE wt END,
    CASE WHEN kind IN ('paused', 'same', 'stray', 'blank') OR (ok AND kind = 'surge') THEN NULL WHEN kind = 'surge' THEN c ELSE sv END,
    CASE WHEN kind IN ('paused', 'same', 'stray', 'blank') OR (ok AND kind = 'surge') THEN NULL WHEN kind = 'surge' THEN t ELSE st END
  FROM (SELECT *, coalesce(CASE kind WHEN 'rise' THEN wv = c AND t - wt <= 2000 WHEN 'surge' THEN t - st <= 2000 AND c - sv BETWEEN 0 AND 500 END, FALSE) AS ok
    FROM (SELECT *, CASE WHEN paused THEN 'paused' WHEN c IS NULL THEN CASE WHEN fever THEN 'blank in fever' ELSE 'blank' END WHEN val IS NULL THEN 'rise' WHEN c < val THEN 'fall' WHEN c = val THEN 'same'
        WHEN fever THEN CASE WHEN sure AND NOT misread AND c - val <= 500 THEN 'surge' ELSE 'noise' END WHEN c - val > 2000 THEN 'leap' WHEN misread THEN 'stray' ELSE 'rise' END AS kind
      FROM (SELECT o.session_id, o.i, o.event_id, o.t, o.c, o.paused, o.fever, o.sure, r.val, r.wv, r.wt, r.sv, r.st,
          (length(ct) = length(CAST(val AS VARCHAR)) + 1 AND (starts_with(ct, CAST(val AS VARCHAR)) OR ends_with(ct, CAST(val AS VARCHAR))))
          OR (length(ct) = length(CAST(val AS VARCHAR)) AND length(ct) > 1 AND ct[1] <> CAST(val AS VARCHAR)[1] AND ct[2:] = CAST(val AS VARCHAR)[2:]) AS misread
        FROM r JOIN o ON o.session_id = r.session_id AND o.i = r.i + 1))))
SELECT session_id, event_id, t AS t_ms, c AS candidate, shown AS accepted, reason FROM r WHERE i > 0"""


@query("coin_machine", COIN_SQL)
def coin_machine(spark, folder):
    rows = coin_samples(spark, folder)
    return ops.coin_counter(rows, time_order(rows))


def level_rows(spark, folder):
    k, e = F.col("k"), F.col("event_id")
    inferred = F.expr("1 + t_ms div 60000")
    raw = F.when(e % 14 == 0, None).when(k % 13 == 0, inferred + 15).when(k % 9 == 0, inferred + 3).when(k % 11 == 0, F.greatest(F.lit(1), inferred - 6)).otherwise(inferred)
    return signals(spark, folder).select(
        "session_id", "event_id", "t_ms", inferred.alias("inferred_level"), raw.cast("long").alias("raw_level"), (0.3 + k % 60 / 100.0).alias("confidence"),
        F.when(e % 17 == 0, "12").otherwise("LV 12").alias("raw_text"), ((F.col("event_type") == "signup") & (k % 3 == 0)).alias("boundary"),
        inferred.alias("before_level"), (inferred + F.when(k % 2 == 0, 1).otherwise(2)).alias("after_level"))


_LEVEL_SQL = """
lr AS (SELECT session_id, event_id, t_ms, 1 + t_ms // 60000 AS inf, CASE WHEN event_id % 14 = 0 THEN NULL WHEN k % 13 = 0 THEN 1 + t_ms // 60000 + 15 WHEN k % 9 = 0 THEN 1 + t_ms // 60000 + 3 WHEN k % 11 = 0 THEN greatest(1, 1 + t_ms // 60000 - 6) ELSE 1 + t_ms // 60000 END AS raw,
   30 + k % 60 AS conf, event_id % 17 = 0 AS plain FROM sig),
lg AS (SELECT *, CASE WHEN raw IS NULL THEN 'ocr_missing' WHEN conf < 45 THEN 'ocr_low_confidence' WHEN plain THEN 'ocr_missing_lv_prefix' WHEN raw > inf + 8 THEN 'ocr_too_far_ahead_of_reset_count' WHEN raw < greatest(1, inf - 2) THEN 'ocr_too_far_behind_reset_count' ELSE 'accepted' END AS gate FROM lr),
ls AS (SELECT *, list(CASE WHEN gate = 'accepted' THEN raw END) OVER (PARTITION BY session_id ORDER BY t_ms, event_id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS ahead FROM lg),
lv AS (SELECT *, gate = 'accepted' AND len(list_filter(coalesce(ahead, []), lambda x: x < raw)) >= 2 AS spike FROM ls)"""


@query("level_gate", f"""
WITH {SIGNAL_SQL}, {_LEVEL_SQL} SELECT session_id, event_id, raw AS raw_level, gate = 'accepted' AND NOT spike AS valid, CASE WHEN spike THEN 'ocr_temporal_spike' ELSE gate END AS validation FROM lv""")
def level_gate(spark, folder):
    rows = level_rows(spark, folder).withColumn("confidence", F.round("confidence", 6))
    return ops.without_spikes(ops.level_gates(rows, time_order(rows))).select("session_id", "event_id", "raw_level", "valid", "validation")


@query("level_chain")
def level_chain(spark, folder):
    rows = level_rows(spark, folder).withColumn("confidence", F.round("confidence", 6))
    gated = ops.without_spikes(ops.level_gates(rows, time_order(rows)))
    return ops.level_chain(gated, time_order(gated))
