"""Clock parsing, clock quality, run segmentation and ledger checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.functions.scalars import clock_seconds, clock_text
from sessionlake.operators import clocks
from sessionlake.operators.ordering import time_order
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import COUNTER_SQL, SESSION_DURATION_MS, SIGNAL_SQL, counters, signals

_TEXT_SQL = SIGNAL_SQL + """,
shown AS (SELECT *, CASE WHEN event_id % 31 = 0 THEN t_ms // 1000 + 900 WHEN event_id % 43 = 0 THEN t_ms // 2000
                         WHEN event_id % 53 = 0 THEN 3700 + t_ms // 1000 ELSE t_ms // 1000 END AS s FROM sig),
txt AS (SELECT session_id, event_id, t_ms, CASE
   WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 17 = 0 THEN '12:75'
   WHEN event_id % 19 = 0 THEN 'LV12' WHEN event_id % 23 = 0 THEN '1:2:3:4' WHEN event_id % 29 = 0 THEN '1:75:03'
   WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)
   ELSE printf('%02d:%02d', s // 60, s % 60) END AS raw_text FROM shown)"""

_PARSE_SQL = """
p AS (SELECT *, trim(raw_text) AS x,
  regexp_full_match(trim(raw_text), '[0-9]+:[0-9]+') AS two, regexp_full_match(trim(raw_text), '[0-9]+:[0-9]+:[0-9]+') AS three,
  TRY_CAST(split_part(trim(raw_text), ':', 1) AS BIGINT) AS a, TRY_CAST(split_part(trim(raw_text), ':', 2) AS BIGINT) AS b,
  TRY_CAST(split_part(trim(raw_text), ':', 3) AS BIGINT) AS d FROM txt),
q AS (SELECT session_id, event_id, t_ms, raw_text, CASE
    WHEN x IS NULL OR x = '' THEN 'missing_ocr' WHEN two AND b >= 60 THEN 'seconds_out_of_range'
    WHEN three AND (b >= 60 OR d >= 60) THEN 'clock_component_out_of_range' WHEN two OR three THEN NULL
    WHEN NOT regexp_full_match(x, '[0-9:]+') THEN 'invalid_characters' ELSE 'invalid_clock_format' END AS reason,
    CASE WHEN two AND b < 60 THEN a * 60 + b WHEN three AND b < 60 AND d < 60 THEN a * 3600 + b * 60 + d END AS v FROM p)"""


def clock_texts(spark, folder):
    shown = F.expr("CASE WHEN event_id % 31 = 0 THEN t_ms div 1000 + 900 WHEN event_id % 43 = 0 THEN t_ms div 2000 "
                   "WHEN event_id % 53 = 0 THEN 3700 + t_ms div 1000 ELSE t_ms div 1000 END")
    damage = {11: None, 13: " ", 17: "12:75", 19: "LV12", 23: "1:2:3:4", 29: "1:75:03"}
    text = F.when(F.lit(False), "")
    for divisor, value in damage.items():
        text = text.when(F.col("event_id") % divisor == 0, F.lit(value))
    return signals(spark, folder).select(
        "session_id", "event_id", "t_ms", text.otherwise(clock_text(shown)).alias("raw_text"))


@query("clock_parse", f"""
WITH {_TEXT_SQL}, {_PARSE_SQL}
SELECT session_id, event_id, v AS seconds, reason,
       CASE WHEN v >= 3600 THEN printf('%02d:%02d:%02d', v // 3600, v % 3600 // 60, v % 60)
            WHEN v IS NOT NULL THEN printf('%02d:%02d', v // 60, v % 60) END AS shown FROM q""")
def clock_parse(spark, folder):
    rows = clock_texts(spark, folder).withColumn("c", clock_seconds(F.col("raw_text")))
    return rows.select("session_id", "event_id", "c.seconds", "c.reason",
                       F.when(F.col("c.seconds").isNotNull(), clock_text(F.col("c.seconds"))).alias("shown"))


@query("clock_qc", f"""
WITH {_TEXT_SQL}, {_PARSE_SQL},
n AS (SELECT *, row_number() OVER w AS i,
   last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv,
   first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nv
   FROM q WINDOW w AS (PARTITION BY session_id ORDER BY t_ms, event_id)),
r AS (SELECT *, coalesce(v > {int(SESSION_DURATION_MS / 1000 * 2.1) + 2}, false) AS beyond,
   coalesce((v < pv AND nv >= pv) OR (v > nv AND nv >= pv), false) AS isolated FROM n),
m AS (SELECT *, max(CASE WHEN NOT beyond AND NOT isolated THEN v END) OVER (PARTITION BY session_id ORDER BY t_ms, event_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fl FROM r),
b AS (SELECT *, coalesce(NOT beyond AND NOT isolated AND v < fl, false) AS backward FROM m),
k AS (SELECT *, CASE WHEN NOT beyond AND NOT isolated AND NOT backward THEN v END AS acc FROM b),
l AS (SELECT *, last_value(acc IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pa,
   last_value(CASE WHEN acc IS NOT NULL THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi
   FROM k WINDOW w AS (PARTITION BY session_id ORDER BY t_ms, event_id)),
j AS (SELECT *, coalesce(acc - pa > 3 * greatest(1, i - pi), false) AS jumped FROM l)
SELECT session_id, event_id, t_ms, raw_text, v AS parsed_s, acc AS accepted_s,
  CASE WHEN reason = 'missing_ocr' THEN 'missing' WHEN reason IS NOT NULL OR acc IS NULL THEN 'rejected'
       WHEN jumped THEN 'review' ELSE 'accepted' END AS status,
  CASE WHEN reason IS NOT NULL THEN reason
       WHEN acc IS NULL THEN concat_ws('|', CASE WHEN isolated THEN 'isolated_order_violation' END,
            CASE WHEN backward THEN 'monotonicity_violation' END, CASE WHEN beyond THEN 'outside_video_clock_bound' END)
       WHEN jumped THEN 'large_positive_clock_discontinuity' ELSE '' END AS reasons FROM j""")
def clock_qc(spark, folder):
    rows = clock_texts(spark, folder)
    return clocks.clock_quality(rows, time_order(rows), "raw_text", SESSION_DURATION_MS)


_RUN_SQL = SIGNAL_SQL + """,
o AS (SELECT session_id, event_id, t_ms, t_ms // 1000 AS second, (t_ms // 1000) % 200 // 5 AS clock_s FROM sig WHERE event_id % 6 <> 0)"""


def _run_clock(spark, folder):
    clock = F.expr("CASE WHEN event_id % 6 <> 0 THEN (t_ms div 1000) % 200 div 5 END")
    return signals(spark, folder).select("session_id", "event_id", "t_ms", F.expr("t_ms div 1000").alias("second"), clock.alias("clock_s"))


@query("run_segments", f"""
WITH {_RUN_SQL},
l AS (SELECT *, lag(second) OVER w AS ps, lag(clock_s) OVER w AS pc,
   coalesce(sum(CASE WHEN clock_s <= 1 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
   FROM o WINDOW w AS (PARTITION BY session_id ORDER BY t_ms, event_id)),
g AS (SELECT *, sum(CASE WHEN clock_s <= 1 AND (seen = 0 OR clock_s + 10 < pc OR ps IS NULL OR second - ps >= 5) THEN 1 ELSE 0 END)
   OVER (PARTITION BY session_id ORDER BY t_ms, event_id) AS run FROM l)
SELECT session_id, CAST(run AS BIGINT) AS run_index, min(second) * 1000 AS start_ms, (max(second) + 1) * 1000 AS end_ms,
   (max(second) + 1) * 1000 - min(second) * 1000 AS duration_ms
FROM g WHERE run > 0 GROUP BY ALL""")
def run_segments(spark, folder):
    rows = _run_clock(spark, folder)
    return clocks.gameplay_runs(rows, time_order(rows), second="second", clock="clock_s")


_TIMER_SQL = SIGNAL_SQL + """,
tx AS (SELECT session_id, event_id, t_ms // 1000 AS second, CASE
   WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 7 = 0 THEN printf('%02d:%02d', t_ms // 60000, t_ms // 1000 % 60) || printf('%d', k)
   WHEN event_id % 5 = 0 THEN '7' || printf('%02d:%02d', t_ms // 60000, t_ms // 1000 % 60) || ':' || printf('%02d', k)
   WHEN event_id % 3 = 0 THEN 'T ' || printf('%02d:%02d', t_ms // 60000, k)
   ELSE printf('%02d:%02d', t_ms // 60000, t_ms // 1000 % 60) END AS txt, (event_id * 7919 % 1000) / 1000.0 AS confidence FROM sig),
cl AS (SELECT *, regexp_replace(txt, '[^0-9:]', '', 'g') AS x FROM tx),
em AS (SELECT *, list_filter(list_transform(range(1, greatest(length(x) - 4, 1) + 1), lambda i: substr(x, i, 5)),
   lambda s: regexp_full_match(s, '[0-9]{2}:[0-9]{2}') AND TRY_CAST(substr(s, 4, 2) AS INT) < 60) AS hits,
   regexp_full_match(x, '[0-9]{2}:[0-9]{2}') AND TRY_CAST(substr(x, 4, 2) AS INT) < 60 AS exact FROM cl),
nm AS (SELECT *, CASE WHEN txt IS NULL THEN 'missing_text' WHEN exact THEN 'exact_cleaned_mm_ss' WHEN len(hits) = 1 THEN 'unique_embedded_mm_ss'
   WHEN len(hits) > 1 THEN 'ambiguous_embedded_mm_ss' ELSE 'no_valid_mm_ss' END AS policy,
   CASE WHEN exact THEN x WHEN len(hits) = 1 THEN hits[1] END AS value FROM em)"""


def _timer_texts(spark, folder):
    mmss = F.format_string("%02d:%02d", F.expr("t_ms div 60000"), F.expr("t_ms div 1000 % 60"))
    text = (F.when(F.col("event_id") % 9 == 0, F.lit(None).cast("string"))
            .when(F.col("event_id") % 7 == 0, F.concat(mmss, F.col("k").cast("string")))
            .when(F.col("event_id") % 5 == 0, F.concat(F.lit("7"), mmss, F.lit(":"), F.format_string("%02d", "k")))
            .when(F.col("event_id") % 3 == 0, F.concat(F.lit("T "), F.format_string("%02d:%02d", F.expr("t_ms div 60000"), F.col("k"))))
            .otherwise(mmss))
    rows = signals(spark, folder).select("session_id", "event_id", F.expr("t_ms div 1000").alias("second"), text.alias("txt"),
                                         (F.col("event_id") * 7919 % 1000 / 1000.0).alias("confidence"))
    return rows.withColumn("n", clocks.normalised_timer(F.col("txt"), True)).select(
        "session_id", "event_id", "second", "confidence", "n.value", "n.policy")


@query("timer_policies", f"WITH {_TIMER_SQL} SELECT session_id, event_id, value, policy FROM nm")
def timer_policies(spark, folder):
    return _timer_texts(spark, folder).select("session_id", "event_id", "value", "policy")


@query("timer_selection", f"""
WITH {_TIMER_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, second ORDER BY (value IS NULL), confidence DESC, event_id) AS rn,
      count(value) OVER (PARTITION BY session_id, second) AS n FROM nm)
SELECT session_id, second, value IS NOT NULL AS observed, value, CASE WHEN value IS NOT NULL THEN confidence END AS confidence,
       n AS valid_candidates FROM r WHERE rn = 1""")
def timer_selection(spark, folder):
    return clocks.best_candidate(_timer_texts(spark, folder), ["session_id", "second"], "value", "confidence", "event_id")


@query("gameplay_onset", f"""
WITH {SIGNAL_SQL},
q AS (SELECT session_id, t_ms // 10000 AS second FROM sig WHERE event_type <> 'error' AND k >= 20 GROUP BY ALL),
i AS (SELECT *, second - row_number() OVER (PARTITION BY session_id ORDER BY second) AS g FROM q),
s AS (SELECT session_id, g, min(second) AS onset_second, count(*) AS n FROM i GROUP BY ALL)
SELECT session_id, min(onset_second) AS onset_second FROM s WHERE n >= 2 GROUP BY ALL""")
def gameplay_onset(spark, folder):
    seconds = signals(spark, folder).filter((F.col("event_type") != "error") & (F.col("k") >= 20)).groupBy(
        "session_id", F.expr("t_ms div 10000").alias("second")).agg(F.count(F.lit(1)).alias("samples"))
    return clocks.first_sustained(seconds)


_LEDGER_SQL = COUNTER_SQL + """,
sec AS (SELECT session_id, t_ms // 10000 AS second, bool_or(event_id % 3 <> 0) AS timer_observed, bool_or(event_id % 4 <> 0) AS counter_observed,
        bool_or(event_type = 'error' AND k < 30) AS excluded, max(CASE WHEN event_id % 61 = 0 THEN c + 400 ELSE c END) AS cmax, min(second_t) AS x FROM
        (SELECT *, t_ms AS second_t FROM cnt) GROUP BY session_id, t_ms // 10000),
led AS (SELECT session_id, second, timer_observed, counter_observed AND second >= 3 AS counter_observed, excluded,
        CASE WHEN excluded THEN NULL WHEN second < 3 THEN 0 ELSE cmax END AS counter_state,
        CASE WHEN excluded THEN 'excluded_level_up_pause' WHEN second < 3 THEN 'assumed_initial_state'
             WHEN counter_observed THEN 'observed' ELSE 'carried_forward' END AS state_source FROM sec)"""


def hud_ledger(spark, folder):
    rows = counters(spark, folder)
    seconds = rows.groupBy("session_id", F.expr("t_ms div 10000").alias("second")).agg(
        F.bool_or(F.col("event_id") % 3 != 0).alias("timer_observed"), F.bool_or(F.col("event_id") % 4 != 0).alias("read"),
        F.bool_or((F.col("event_type") == "error") & (F.col("k") < 30)).alias("excluded"),
        F.max(F.when(F.col("event_id") % 61 == 0, F.col("c") + 400).otherwise(F.col("c"))).alias("top"))
    early = F.col("second") < 3
    return seconds.select(
        "session_id", "second", "timer_observed", (F.col("read") & ~early).alias("counter_observed"), "excluded",
        F.when(F.col("excluded"), None).when(early, 0).otherwise(F.col("top")).cast("long").alias("counter_state"),
        F.when(F.col("excluded"), "excluded_level_up_pause").when(early, "assumed_initial_state")
        .when(F.col("read"), "observed").otherwise("carried_forward").alias("state_source"))


@query("ledger_quality", f"""
WITH {_LEDGER_SQL},
w AS (SELECT *, lag(second) OVER v AS ps, max(CASE WHEN NOT excluded AND counter_state > 0 THEN 1 ELSE 0 END) OVER v AS pos,
      last_value(counter_state IGNORE NULLS) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls
      FROM led WINDOW v AS (PARTITION BY session_id ORDER BY second)),
a AS (SELECT session_id, count(*) AS rows, count(*) FILTER (NOT excluded) AS eligible_seconds,
      count(*) FILTER (NOT excluded AND timer_observed) AS timer_observed_count,
      count(*) FILTER (NOT excluded AND counter_observed) AS counter_observed_count,
      count(*) FILTER (NOT excluded AND pos = 0 AND NOT counter_observed AND counter_state = 0
                       AND state_source IN ('carried_forward', 'assumed_initial_state')) AS blank_zero_seconds,
      count(*) FILTER (state_source = 'carried_forward') AS carried_count,
      count(*) FILTER (second - ps <> 1) AS gaps, count(*) FILTER (counter_state < ls) AS drops FROM w GROUP BY ALL),
r AS (SELECT *, round(CASE WHEN eligible_seconds > 0 THEN timer_observed_count / eligible_seconds ELSE 0 END, 8) AS timer_rate,
      round(CASE WHEN eligible_seconds - blank_zero_seconds > 0 THEN counter_observed_count / (eligible_seconds - blank_zero_seconds)
            ELSE 0 END, 8) AS counter_rate FROM a),
f AS (SELECT *, concat_ws('|', CASE WHEN drops > 0 THEN 'counter_state_is_monotonic' END,
      CASE WHEN counter_rate < 0.6 THEN 'counter_observed_rate_meets_threshold' END,
      CASE WHEN gaps > 0 THEN 'seconds_are_contiguous' END,
      CASE WHEN timer_rate < 0.6 THEN 'timer_observed_rate_meets_threshold' END) AS failed_checks FROM r)
SELECT session_id, rows, eligible_seconds, timer_observed_count, counter_observed_count, blank_zero_seconds, carried_count,
       timer_rate, counter_rate, failed_checks, CASE WHEN failed_checks <> '' THEN 'failed'
       WHEN timer_rate < 0.5 OR counter_rate < 0.5 THEN 'warning' ELSE 'passed' END AS status FROM f""")
def ledger_quality(spark, folder):
    return clocks.ledger_quality(hud_ledger(spark, folder), min_timer_rate=0.6, min_counter_rate=0.6)


@query("ledger_excluded_windows", f"""
WITH {SIGNAL_SQL}
SELECT session_id, t_ms // 10000 AS second, count(*) AS samples, bool_or(event_type = 'error') AS excluded,
       CASE WHEN NOT bool_or(event_type = 'error') THEN max(k) END AS value,
       CASE WHEN bool_or(event_type = 'error') THEN 'excluded_level_up_pause' ELSE 'observed' END AS status
FROM sig GROUP BY ALL""")
def ledger_excluded_windows(spark, folder):
    """One paused sample makes the whole second unusable."""
    paused = F.bool_or(F.col("event_type") == "error")
    return signals(spark, folder).groupBy("session_id", F.expr("t_ms div 10000").alias("second")).agg(
        F.count(F.lit(1)).alias("samples"), paused.alias("excluded"), F.when(~paused, F.max("k")).alias("value"),
        F.when(paused, "excluded_level_up_pause").otherwise("observed").alias("status"))
