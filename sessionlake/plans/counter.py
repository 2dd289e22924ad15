"""Counter validation and repair, bar signals and experience estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.operators import binning, counters as ops
from sessionlake.operators.ordering import running_sum, time_order
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import COUNTER_SQL, NOISY_SQL, SIGNAL_SQL, counters, noisy_counters, signals

_W = "PARTITION BY session_id ORDER BY t_ms, event_id"


@query("corroborated_points", f"""
WITH {SIGNAL_SQL}, p AS (SELECT session_id, event_id, t_ms, k % 4 AS reading FROM sig WHERE event_type <> 'error'),
l AS (SELECT *, lag(reading) OVER w AS pv, lag(t_ms) OVER w AS pt, lead(reading) OVER w AS nv, lead(t_ms) OVER w AS nt
      FROM p WINDOW w AS ({_W}))
SELECT session_id, event_id, t_ms, reading FROM l
WHERE (pv = reading AND t_ms - pt <= 6000) OR (nv = reading AND nt - t_ms <= 6000)""")
def corroborated_points(spark, folder):
    rows = signals(spark, folder).filter("event_type <> 'error'").select(
        "session_id", "event_id", "t_ms", (F.col("k") % 4).alias("reading"))
    return ops.corroborated(rows, time_order(rows), "reading", 6_000)


@query("truncated_restore", f"""
WITH {COUNTER_SQL}, p AS (SELECT session_id, event_id, c % 1000 AS stored,
  CASE WHEN event_id % 5 = 0 THEN 'G ' || c WHEN event_id % 7 = 0 THEN NULL ELSE CAST(c % 1000 AS VARCHAR) END AS raw_text FROM cnt),
q AS (SELECT *, TRY_CAST(regexp_replace(coalesce(raw_text, ''), '[^0-9]', '', 'g') AS BIGINT) AS fv FROM p),
r AS (SELECT *, coalesce(fv - stored >= 1000 AND suffix(CAST(fv AS VARCHAR), CAST(stored AS VARCHAR)), false) AS hit FROM q)
SELECT session_id, event_id, stored, CASE WHEN hit THEN fv ELSE stored END AS value,
       CASE WHEN hit THEN 'full_raw_ocr_restored' END AS reason FROM r""")
def truncated_restore(spark, folder):
    text = F.expr("CASE WHEN event_id % 5 = 0 THEN concat('G ', c) WHEN event_id % 7 = 0 THEN NULL ELSE string(c % 1000) END")
    rows = counters(spark, folder).select("session_id", "event_id", (F.col("c") % 1000).alias("stored"), text.alias("raw_text"))
    fixed = ops.restored_from_text(F.col("stored"), F.col("raw_text"))
    return rows.select("session_id", "event_id", "stored", fixed.alias("f")).select("session_id", "event_id", "stored", "f.*")


_SHIFTED_SQL = COUNTER_SQL + """,
sh AS (SELECT session_id, event_id, t_ms, CASE WHEN session_id % 3 = 0 AND t_ms BETWEEN 360000 AND 600000 THEN c + 4000
       WHEN event_id % 47 = 0 THEN c * 2 ELSE c END AS reading FROM cnt)"""

_SHIFT_FIX_SQL = f"""
a AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY session_id) AS n, lag(reading) OVER w AS p,
      lead(reading, 1) OVER w AS x1, lead(reading, 2) OVER w AS x2 FROM sh WINDOW w AS ({_W})),
m AS (SELECT *, CAST(pow(10, greatest(1, length(CAST(reading - p AS VARCHAR)) - 1)) AS BIGINT) AS mag FROM a),
o AS (SELECT m.*, mag * u AS off, abs(reading - mag * u - p) AS miss FROM m, range(1, 10) AS r(u)
      WHERE n >= 4 AND reading - p >= 1000 AND (x1 IS NULL OR x1 >= reading) AND (x2 IS NULL OR x2 >= x1)
        AND reading - mag * u >= 0 AND reading - mag * u >= p AND reading - mag * u - p < 1000),
f AS (SELECT session_id, i AS fi, off FROM o
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i, miss, off) = 1),
b AS (SELECT a.*, f.fi, f.off, max(CASE WHEN a.i >= f.fi AND (reading - off < 0 OR (a.i > f.fi AND reading < p)) THEN 1 ELSE 0 END)
      OVER (PARTITION BY a.session_id ORDER BY a.i) AS ended FROM a LEFT JOIN f USING (session_id)),
fx AS (SELECT session_id, event_id, t_ms, i, reading,
      CASE WHEN i >= fi AND ended = 0 THEN CAST(reading - off AS BIGINT) ELSE reading END AS repaired,
      CASE WHEN i >= fi AND ended = 0 THEN 'persistent_leading_place_ocr_shift_corrected' END AS repair_reason FROM b)"""


def _shifted(spark, folder):
    reading = F.expr("CASE WHEN session_id % 3 = 0 AND t_ms BETWEEN 360000 AND 600000 THEN c + 4000 "
                     "WHEN event_id % 47 = 0 THEN c * 2 ELSE c END")
    return counters(spark, folder).select("session_id", "event_id", "t_ms", reading.alias("reading"))


@query("leading_shift", f"""
WITH {_SHIFTED_SQL}, {_SHIFT_FIX_SQL} SELECT session_id, event_id, t_ms, reading, repaired, repair_reason FROM fx""")
def leading_shift(spark, folder):
    rows = _shifted(spark, folder)
    return ops.leading_shift_repair(rows, time_order(rows), "reading")


def _isolated_sql(source: str, value: str) -> str:
    return f"""
iso AS (
  SELECT session_id, event_id, i, {value} AS cur, {value} AS rep, FALSE AS held FROM {source} WHERE i = 1
  UNION ALL
  SELECT s.session_id, s.event_id, s.i, s.cur,
    CASE WHEN (s.cur > r.rep AND s.nxt < s.cur AND s.nxt >= r.rep) OR (s.cur < r.rep AND s.nxt >= r.rep) THEN r.rep ELSE s.cur END,
    coalesce((s.cur > r.rep AND s.nxt < s.cur AND s.nxt >= r.rep) OR (s.cur < r.rep AND s.nxt >= r.rep), FALSE)
  FROM iso r JOIN (SELECT session_id, event_id, i, {value} AS cur, lead({value}) OVER (PARTITION BY session_id ORDER BY i) AS nxt
                   FROM {source}) s ON s.session_id = r.session_id AND s.i = r.i + 1)"""


@query("isolated_repair", f"""
WITH RECURSIVE {NOISY_SQL}, src AS (SELECT *, row_number() OVER ({_W}) AS i FROM noisy WHERE raw IS NOT NULL), {_isolated_sql('src', 'raw')}
SELECT session_id, iso.event_id, sig.t_ms, cur AS raw, rep AS repaired,
       CASE WHEN held THEN 'isolated_cumulative_counter_ocr_discontinuity_rejected' END AS repair_reason
FROM iso JOIN sig USING (session_id, event_id)""")
def isolated_repair(spark, folder):
    rows = noisy_counters(spark, folder).filter("raw IS NOT NULL").select("session_id", "event_id", "t_ms", "raw")
    return ops.isolated_repair(rows, time_order(rows), "raw")


@query("repaired_counter", f"""
WITH RECURSIVE {_SHIFTED_SQL}, {_SHIFT_FIX_SQL}, {_isolated_sql('fx', 'repaired')}
SELECT fx.session_id, fx.event_id, fx.t_ms, fx.reading, rep AS repaired,
       CASE WHEN held THEN 'isolated_cumulative_counter_ocr_discontinuity_rejected' ELSE fx.repair_reason END AS repair_reason
FROM iso JOIN fx USING (session_id, event_id)""")
def repaired_counter(spark, folder):
    rows = _shifted(spark, folder)
    return ops.repaired_counter(rows, time_order(rows), "reading")


@query("counter_quality", f"""
WITH {NOISY_SQL}, d AS (SELECT *, raw - lag(raw) OVER ({_W}) AS delta FROM noisy WHERE raw IS NOT NULL),
a AS (SELECT session_id, count(*) AS n, count(*) FILTER (delta < 0) AS negative_deltas, coalesce(max(delta), 0) AS largest_increase,
      count(*) - count(DISTINCT raw) AS repeated_values FROM d GROUP BY ALL)
SELECT *, negative_deltas = 0 AS monotonic FROM a""")
def counter_quality(spark, folder):
    rows = noisy_counters(spark, folder).filter("raw IS NOT NULL").select("session_id", "event_id", "t_ms", "raw")
    return ops.counter_summary(rows, time_order(rows), "raw")


@query("counter_candidate", f"""
WITH {SIGNAL_SQL}, c AS (SELECT session_id, t_ms // 1000 AS second, (event_id * 31 % 100) / 100.0 AS confidence, k AS value,
   'x' || k AS raw_text FROM sig)
SELECT session_id, second, value, confidence, raw_text FROM c
QUALIFY row_number() OVER (PARTITION BY session_id, second ORDER BY confidence DESC, value DESC, raw_text DESC) = 1""")
def counter_candidate(spark, folder):
    """Most confident reading in the lower part of the counter area; the larger value wins a tie."""
    rows = signals(spark, folder).select(
        "session_id", F.expr("t_ms div 1000").alias("second"), (F.col("event_id") * 31 % 100 / 100.0).alias("confidence"),
        F.concat(F.lit("x"), F.col("k").cast("string")).alias("raw_text"))
    best = F.max(F.struct("confidence", F.regexp_replace("raw_text", "[^0-9]", "").cast("long").alias("value"), "raw_text"))
    return rows.groupBy("session_id", "second").agg(best.alias("b")).select(
        "session_id", "second", "b.value", "b.confidence", "b.raw_text")


ACTIONS = ("reroll", "skip", "banish")


@query("action_counter_text", f"""
WITH {SIGNAL_SQL}, t AS (SELECT session_id, event_id, CASE WHEN event_id % 4 = 0 THEN 'Reroll +' || k || ' Skip -'
   WHEN event_id % 4 = 1 THEN 'reroll 4' || (100 + k) || ' SKIP ' || k WHEN event_id % 4 = 2 THEN 'Banish +' || k ELSE 'none' END AS txt FROM sig),
d AS (SELECT *, regexp_extract(txt, '(?i)reroll\\s*\\+?\\s*(\\d+)', 1) AS r, regexp_extract(txt, '(?i)skip\\s*\\+?\\s*(\\d+)', 1) AS s,
   regexp_extract(txt, '(?i)banish\\s*\\+?\\s*(\\d+)', 1) AS b FROM t)
SELECT session_id, event_id,
   CASE WHEN length(r) >= 4 AND r LIKE '4%' AND CAST(r[2:] AS BIGINT) <= 999 THEN CAST(r[2:] AS BIGINT) ELSE TRY_CAST(r AS BIGINT) END AS reroll,
   CASE WHEN length(s) >= 4 AND s LIKE '4%' AND CAST(s[2:] AS BIGINT) <= 999 THEN CAST(s[2:] AS BIGINT) ELSE TRY_CAST(s AS BIGINT) END AS skip,
   CASE WHEN length(b) >= 4 AND b LIKE '4%' AND CAST(b[2:] AS BIGINT) <= 999 THEN CAST(b[2:] AS BIGINT) ELSE TRY_CAST(b AS BIGINT) END AS banish
FROM d""")
def action_counter_text(spark, folder):
    text = F.expr("CASE WHEN event_id % 4 = 0 THEN concat('Reroll +', k, ' Skip -') WHEN event_id % 4 = 1 THEN "
                  "concat('reroll 4', 100 + k, ' SKIP ', k) WHEN event_id % 4 = 2 THEN concat('Banish +', k) ELSE 'none' END")
    rows = signals(spark, folder).withColumn("txt", text)
    return rows.select("session_id", "event_id", *[col.alias(name) for name, col in ops.action_counts(F.col("txt"), ACTIONS).items()])


@query("counter_drops", f"""
WITH {SIGNAL_SQL}, p AS (SELECT session_id, event_id, t_ms, 20 - t_ms // 40000 + CASE WHEN k % 9 = 0 THEN -3 WHEN k % 11 = 0 THEN 2 ELSE 0 END AS v
   FROM sig WHERE event_id % 6 <> 0),
a AS (SELECT *, row_number() OVER w AS i, lead(v, 1) OVER w AS x1, lead(v, 2) OVER w AS x2, lead(v, 3) OVER w AS x3 FROM p WINDOW w AS ({_W})),
s AS (SELECT *, coalesce(v IN (x1, x2, x3), FALSE) AS again FROM a),
m AS (SELECT *, min(CASE WHEN i = 1 OR again THEN v END) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM s),
t AS (SELECT *, coalesce(i > 1 AND st > v AND (again OR (x1 IS NULL AND st - v <= 3)), FALSE) AS takes FROM m),
l AS (SELECT *, last_value(CASE WHEN i = 1 OR takes OR v = st THEN t_ms END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower_ms FROM t)
SELECT session_id, t_ms, event_id, lower_ms, st AS counter_before, v AS counter_after, again AS confirmed, CAST(u AS INT) AS unit
FROM l, LATERAL (SELECT unnest(range(0, st - v)) AS u) WHERE takes""")
def counter_drops(spark, folder):
    value = F.expr("20 - t_ms div 40000 + CASE WHEN k % 9 = 0 THEN -3 WHEN k % 11 = 0 THEN 2 ELSE 0 END")
    rows = signals(spark, folder).select(
        "session_id", "event_id", "t_ms", F.when(F.col("event_id") % 6 != 0, value).cast("long").alias("v"))
    return ops.confirmed_drops(rows, time_order(rows), "v")


_BAR_SQL = SIGNAL_SQL + """,
bar AS (SELECT session_id, event_id, t_ms, event_type, k, value,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE (t_ms // 1000) % 100 + k % 3 END AS pixels,
  0.70 + (event_id * 17 % 30) / 100.0 AS quality, 0.85 + (event_id * 13 % 15) / 100.0 AS hud, (k % 20) / 200.0 AS overlay,
  event_id % 3 <> 0 AS health_bar FROM sig)"""


def bar_frames(spark, folder):
    return signals(spark, folder).withColumns({
        "pixels": F.expr("CASE WHEN event_id % 5 = 0 THEN 0 ELSE (t_ms div 1000) % 100 + k % 3 END"),
        "quality": 0.70 + F.col("event_id") * 17 % 30 / 100.0, "hud": 0.85 + F.col("event_id") * 13 % 15 / 100.0,
        "overlay": F.col("k") % 20 / 200.0, "health_bar": F.col("event_id") % 3 != 0})


@query("reappearance", f"""
WITH {_BAR_SQL}, l AS (SELECT *, lag(pixels) OVER w AS p, last_value(CASE WHEN pixels > 1 THEN pixels END IGNORE NULLS)
   OVER (w ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING) AS seen FROM bar WINDOW w AS ({_W}))
SELECT session_id, event_id, pixels, coalesce(pixels > 1 AND p <= 1 AND seen >= pixels - 1, FALSE) AS reappeared FROM l""")
def reappearance(spark, folder):
    rows = bar_frames(spark, folder).select("session_id", "t_ms", "event_id", "pixels")
    return ops.reappearances(rows, time_order(rows), "pixels").drop("t_ms")


_GUARD_SQL = f"""
gs AS (SELECT *, k % 20 >= 5 AND NOT health_bar AS strong0, k < 70 AS strong FROM bar),
gi AS (SELECT *, sum(CASE WHEN strong THEN 0 ELSE 1 END) OVER ({_W}) AS g, row_number() OVER ({_W}) AS i FROM gs),
gr AS (SELECT session_id, g, min(i) AS a, max(i) AS b FROM gi WHERE strong GROUP BY ALL HAVING count(*) >= 3),
guard AS (SELECT gi.session_id, gi.event_id, gi.i, EXISTS (SELECT 1 FROM gr WHERE gr.session_id = gi.session_id AND gi.i BETWEEN gr.a - 8 AND gr.b + 8) AS guarded FROM gi)"""


@query("guard_dilation", f"WITH {_BAR_SQL}, {_GUARD_SQL} SELECT session_id, event_id, guarded FROM guard")
def guard_dilation(spark, folder):
    rows = signals(spark, folder).select("session_id", "t_ms", "event_id", "k")
    return ops.transition_guard(rows, time_order(rows), F.col("k") < 70).select("session_id", "event_id", "guarded")


@query("level_curve", f"""
WITH {SIGNAL_SQL}, l AS (SELECT DISTINCT 1 + k % 60 AS level FROM sig)
SELECT level, CAST(CASE WHEN level <= 20 THEN 5.0 + 10.0 * (level - 1) WHEN level <= 40 THEN 195.0 + 13.0 * (level - 20)
  ELSE 455.0 + 16.0 * (level - 40) END + CASE level WHEN 20 THEN 600.0 WHEN 40 THEN 2400.0 ELSE 0.0 END AS DOUBLE) AS required,
  round(CAST(1.15 + 0.10 * least(level // 5, 3) + CASE WHEN level IN (20, 40) THEN 1.0 ELSE 0.0 END AS DOUBLE), 6) AS growth FROM l""")
def level_curve(spark, folder):
    levels = signals(spark, folder).select((1 + F.col("k") % 60).alias("level")).distinct()
    return levels.select("level", ops.required_experience(F.col("level")).alias("required"),
                         F.round(ops.growth_multiplier(F.col("level")), 6).alias("growth"))


@query("value_band", f"""
WITH {SIGNAL_SQL}
SELECT event_id, CASE WHEN value <= 0 OR k >= 95 THEN 'unknown' WHEN value / 10 <= 2.25 THEN 'blue' WHEN value / 10 <= 9.5 THEN 'green' ELSE 'red' END AS band,
       CASE WHEN value <= 0 OR k >= 95 THEN 'unknown' WHEN value / 10 <= 3.0 THEN 'blue' WHEN value / 10 <= 11.0 THEN 'green' ELSE 'red' END AS hint FROM sig""")
def value_band(spark, folder):
    rows = signals(spark, folder)
    gain, saturated = F.col("value") / 10, F.col("k") >= 95
    return rows.select("event_id", ops.value_band(gain, saturated, 2.25, 9.5).alias("band"), ops.value_band(gain, saturated, 3.0, 11.0).alias("hint"))


@query("step_estimate", f"""
WITH {_BAR_SQL}, e AS (SELECT *, 1 + k % 30 AS level, 1 + k % 7 AS delta_pixels, k >= 90 AS saturated FROM bar),
c AS (SELECT *, CASE WHEN level <= 20 THEN 5.0 + 10.0 * (level - 1) ELSE 195.0 + 13.0 * (level - 20) END + CASE level WHEN 20 THEN 600.0 ELSE 0.0 END AS required,
      1.15 + 0.10 * least(level // 5, 3) + CASE WHEN level = 20 THEN 1.0 ELSE 0.0 END AS growth FROM e),
q AS (SELECT level, count(*) AS n, quantile_cont(CAST(delta_pixels AS DOUBLE), 0.2) AS q FROM c WHERE NOT saturated GROUP BY ALL),
t AS (SELECT c.*, q.n, q.q, 1800.0 * growth / required * 1.25 AS theory FROM c LEFT JOIN q USING (level))
SELECT session_id, event_id, round(CAST(greatest(1.0, CASE WHEN n IS NULL THEN theory WHEN n >= 5 THEN least(q, theory * 1.6) ELSE theory * 1.6 END) AS DOUBLE), 6) AS single_step_pixels,
       round(CAST(delta_pixels / greatest(1.0, CASE WHEN n IS NULL THEN theory WHEN n >= 5 THEN least(q, theory * 1.6) ELSE theory * 1.6 END) AS DOUBLE), 6) AS step_ratio FROM t""")
def step_estimate(spark, folder):
    rows = bar_frames(spark, folder).select("session_id", "event_id", (1 + F.col("k") % 30).alias("level"),
                                            (1 + F.col("k") % 7).alias("delta_pixels"), (F.col("k") >= 90).alias("saturated"))
    open_bar = rows.filter(~F.col("saturated"))
    sizes = open_bar.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    low = binning.group_quantiles(open_bar, ["level"], "delta_pixels", {"q": 0.2}, scale=1)
    per_level = sizes.join(low, "level")
    theory = 1800.0 * ops.growth_multiplier(F.col("level")) / ops.required_experience(F.col("level")) * 1.25
    step = F.greatest(F.lit(1.0), F.when(F.col("n").isNull(), theory).when(F.col("n") >= 5, F.least(F.col("q"), theory * 1.6)).otherwise(theory * 1.6))
    return rows.join(per_level, "level", "left").select(
        "session_id", "event_id", F.round(step, 6).alias("single_step_pixels"), F.round(F.col("delta_pixels") / step, 6).alias("step_ratio"))


@query("signal_diagnostics", f"""
WITH {_BAR_SQL}, f AS (SELECT *, k < 15 AS guarded, k BETWEEN 15 AND 22 AS back FROM bar),
l AS (SELECT *, lag(guarded) OVER w AS pg, lag(back) OVER w AS pb, pixels - lag(pixels) OVER w AS d FROM f WINDOW w AS ({_W}))
SELECT session_id, event_id, NOT guarded AND NOT back AS measurement_valid,
  CASE WHEN guarded THEN 'level_up_transition_guard' WHEN back THEN 'xp_bar_reappearance' ELSE '' END AS rejection_reason,
  coalesce(NOT guarded AND NOT back AND NOT pg AND NOT pb, FALSE) AS delta_valid,
  CASE WHEN NOT guarded AND NOT back THEN pixels END AS endpoint_pixels, pixels AS endpoint_pixels_raw,
  CASE WHEN NOT guarded AND NOT back AND NOT pg AND NOT pb THEN d END AS delta_pixels, coalesce(d, 0) AS delta_pixels_raw FROM l""")
def signal_diagnostics(spark, folder):
    """Accepted and raw readings side by side; a delta also needs a clean previous frame."""
    rows = bar_frames(spark, folder).select("session_id", "t_ms", "event_id", "pixels", (F.col("k") < 15).alias("guarded"),
                                            F.col("k").between(15, 22).alias("back"))
    order = time_order(rows)
    d = order.untag(order.frames(order.tag(rows), 1, pg=lambda w: F.lag("guarded").over(w), pb=lambda w: F.lag("back").over(w),
                                 d=lambda w: F.col("pixels") - F.lag("pixels").over(w)))
    valid = ~F.col("guarded") & ~F.col("back")
    clean = F.coalesce(valid & ~F.col("pg") & ~F.col("pb"), F.lit(False))
    return d.select("session_id", "event_id", valid.alias("measurement_valid"),
                    F.when(F.col("guarded"), "level_up_transition_guard").when(F.col("back"), "xp_bar_reappearance").otherwise("").alias("rejection_reason"),
                    clean.alias("delta_valid"), F.when(valid, F.col("pixels")).alias("endpoint_pixels"), F.col("pixels").alias("endpoint_pixels_raw"),
                    F.when(clean, F.col("d")).alias("delta_pixels"), F.coalesce("d", F.lit(0)).alias("delta_pixels_raw"))


@query("growth_as_of_items", f"""
WITH {SIGNAL_SQL}, a AS (SELECT session_id, t_ms, event_id FROM sig WHERE event_type = 'signup' AND k >= 80),
n AS (SELECT s.*, (SELECT count(*) FROM a WHERE a.session_id = s.session_id AND a.t_ms <= s.t_ms) AS crown_level FROM sig s WHERE event_type <> 'error'),
g AS (SELECT session_id, event_id, crown_level, 1 + k % 60 AS level, value FROM n)
SELECT session_id, event_id, crown_level, round(CAST(value / (1.0 + (15.0 + 10.0 * least(level // 5, 3) + 8.0 * crown_level
   + CASE WHEN level IN (20, 40) THEN 100.0 ELSE 0.0 END) / 100.0) / 1.03 AS DOUBLE), 4) AS normalised_gain FROM g""")
def growth_as_of_items(spark, folder):
    """Gain divided by the growth in force: level bonus plus one step per item activation up to the frame."""
    from sessionlake.operators.timejoin import stream_join

    rows = signals(spark, folder).filter("event_type <> 'error'").select("session_id", "t_ms", "event_id", "value", (1 + F.col("k") % 60).alias("level"))
    activations = signals(spark, folder).filter("event_type = 'signup' AND k >= 80").select("session_id", "t_ms", "event_id")
    d = stream_join(rows, activations, {"crown": running_sum(F.when(F.col("_right").isNotNull(), 1).otherwise(0).cast("long"))})
    total = (15.0 + 10.0 * F.least(F.floor(F.col("level") / 5), F.lit(3)) + 8.0 * F.col("crown")
             + F.when(F.col("level").isin(20, 40), 100.0).otherwise(0.0))
    return d.select("session_id", "event_id", F.col("crown").alias("crown_level"),
                    F.round(F.col("value") / (1.0 + total / 100.0) / 1.03, 4).alias("normalised_gain"))


@query("attractor_state", f"""
WITH {SIGNAL_SQL}, ch AS (SELECT session_id, t_ms, event_id, 'item_' || event_id AS source_id, k < 30 AS needs_review,
    row_number() OVER ({_W}) AS level FROM sig WHERE event_type = 'signup' AND k % 13 = 0),
r AS (SELECT s.session_id, s.event_id, coalesce(least(c.level, 5), 0) AS level, coalesce(c.source_id, 'base_magnet_state') AS source_id,
      coalesce(c.needs_review, FALSE) AS needs_review
      FROM sig s ASOF LEFT JOIN ch c ON s.session_id = c.session_id AND s.t_ms >= c.t_ms WHERE s.event_type = 'click'),
m AS (SELECT *, CASE level WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 WHEN 2 THEN 1.995 WHEN 3 THEN 2.49375 WHEN 4 THEN 2.9925 ELSE 3.980025 END AS mult FROM r)
SELECT session_id, event_id, level, source_id, needs_review, round(CAST(30.0 * 1.25 * mult AS DOUBLE), 6) AS magnet_value,
       round(CAST(least(1280.0, 320.0 * 1.25 * mult) AS DOUBLE), 6) AS search_radius FROM m""")
def attractor_state(spark, folder):
    """Item level in force at each pickup, its multiplier and the capped search radius."""
    from sessionlake.operators.timejoin import asof

    # fixed values: multiplier per item level 0..5
    multipliers = (1.0, 1.5, 1.995, 2.49375, 2.9925, 3.980025)
    changes = signals(spark, folder).filter("event_type = 'signup' AND k % 13 = 0")
    order = time_order(changes)
    changes = order.untag(order.running(order.tag(changes), level=running_sum(F.lit(1).cast("long")))).select(
        "session_id", "t_ms", "event_id", "level", F.concat(F.lit("item_"), F.col("event_id").cast("string")).alias("source_id"),
        (F.col("k") < 30).alias("needs_review"))
    rows = signals(spark, folder).filter("event_type = 'click'").select("session_id", "t_ms", "event_id")
    d = asof(rows, changes, ["level", "source_id", "needs_review"])
    level = F.coalesce(F.least("level", F.lit(5)), F.lit(0)).cast("long")
    mult = F.element_at(F.array(*[F.lit(m) for m in multipliers]), (level + 1).cast("int"))
    return d.select("session_id", "event_id", level.alias("level"), F.coalesce("source_id", F.lit("base_magnet_state")).alias("source_id"),
                    F.coalesce("needs_review", F.lit(False)).alias("needs_review"), F.round(30.0 * 1.25 * mult, 6).alias("magnet_value"),
                    F.round(F.least(F.lit(1280.0), 320.0 * 1.25 * mult), 6).alias("search_radius"))
