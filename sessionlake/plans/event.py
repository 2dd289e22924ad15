"""Derived events and progress across interruptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.functions.scalars import clamp
from sessionlake.operators import counters as counter_ops, events as ops, intervals
from sessionlake.operators.ordering import time_order
from sessionlake.plans.counter import _BAR_SQL, _GUARD_SQL, bar_frames
from sessionlake.plans.interval import _SPAN_SQL, blocking_spans, merged_sql
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import COUNTER_SQL, SIGNAL_SQL, counters, signals

_W = "PARTITION BY session_id ORDER BY t_ms, event_id"

_HP_SQL = f"""
hb AS (SELECT *, event_type = 'error' AND NOT coalesce(lag(event_type = 'error') OVER ({_W}), FALSE) AS begins FROM sig),
hp AS (SELECT session_id, event_id, t_ms, k AS v, event_type <> 'error' AS observed, sum(CAST(begins AS INT)) OVER ({_W}) AS seg FROM hb),
hn AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv, lag(observed) OVER w AS po, lead(observed) OVER w AS no, lag(seg) OVER w AS ps,
   lead(seg) OVER w AS ns, lag(t_ms) OVER w AS pt, lead(t_ms) OVER w AS nt FROM hp WINDOW w AS ({_W}))"""


def _health(spark, folder):
    rows = signals(spark, folder)
    d = intervals.segment_ids(rows, time_order(rows), F.col("event_type") == "error", "segment")
    return d.select("session_id", "event_id", "t_ms", F.col("k").alias("v"), (F.col("event_type") != "error").alias("observed"), "segment")


@query("persistent_change_events", f"""
WITH {SIGNAL_SQL}, {_HP_SQL}
SELECT session_id, event_id, t_ms, CASE WHEN v < pv THEN 'hp_loss' ELSE 'hp_recovery' END AS event_type, CASE WHEN v < pv THEN 'punishment' ELSE 'recovery' END AS event_family,
  pt AS time_lower_ms, abs(v - pv) AS quantity, pv AS previous_value, v AS current_value, nv AS following_value FROM hn
WHERE observed AND po AND no AND ps = seg AND ns = seg AND t_ms - pt <= 15000 AND nt - t_ms <= 15000 AND abs(v - pv) >= 3
  AND CASE WHEN v < pv THEN nv <= v + 1.5 ELSE nv >= v - 1.5 END""")
def persistent_change_events(spark, folder):
    rows = _health(spark, folder)
    return ops.persistent_changes(rows, time_order(rows), "v", "observed", "segment", max_gap_ms=15_000)


@query("abrupt_healing", f"""
WITH {SIGNAL_SQL}, {_HP_SQL}
SELECT session_id, event_id, 'abrupt_healing_effect' AS event_type, 'C' AS evidence_grade, 'needs_review' AS publication_status, v - pv AS quantity FROM hn
WHERE observed AND po AND no AND ps = seg AND ns = seg AND t_ms - pt <= 15000 AND nt - t_ms <= 15000 AND v - pv >= 10 AND nv >= v - 1.5""")
def abrupt_healing(spark, folder):
    """Large persistent recoveries: evidence of healing, not of its cause."""
    return persistent_change_events(spark, folder).filter("event_type = 'hp_recovery' AND quantity >= 10").select(
        "session_id", "event_id", F.lit("abrupt_healing_effect").alias("event_type"), F.lit("C").alias("evidence_grade"),
        F.lit("needs_review").alias("publication_status"), "quantity")


@query("isolated_short", f"""
WITH {SIGNAL_SQL}, w AS (SELECT session_id, event_id, t_ms, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS width, event_type = 'error' AS excluded FROM sig),
n AS (SELECT *, lag(width) OVER w1 AS p, lead(width) OVER w1 AS x FROM w WINDOW w1 AS ({_W})),
f AS (SELECT *, NOT excluded AND coalesce(width < 40, FALSE) AND NOT coalesce(p < 40, FALSE) AND NOT coalesce(x < 40, FALSE) AS lone FROM n)
SELECT session_id, event_id, t_ms, width, excluded, CASE WHEN NOT lone THEN width END AS accepted_width, CASE WHEN lone THEN 'isolated_short_component' END AS rejection_reason FROM f""")
def isolated_short(spark, folder):
    rows = signals(spark, folder).select("session_id", "event_id", "t_ms", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("width"),
                                         (F.col("event_type") == "error").alias("excluded"))
    return ops.isolated_short(rows, time_order(rows), "width", "excluded")


_FULL_SQL = """
wd AS (SELECT session_id, round(CAST(60 + k % 12 + (event_id % 100) / 100.0 AS DOUBLE), 2) AS w FROM sig),
cl AS (SELECT session_id, CAST(round_even(w, 0) AS BIGINT) AS cell, count(*) AS n FROM wd GROUP BY ALL),
su AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY cell RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS support, sum(n) OVER (PARTITION BY session_id) AS total FROM cl),
pk AS (SELECT *, max(support) OVER (PARTITION BY session_id) AS peak FROM su),
ce AS (SELECT session_id, max(cell) AS center, CAST(max(total) AS BIGINT) AS observation_count FROM pk WHERE total >= 10 AND support >= greatest(5, ceil(0.02 * total)) AND support >= 0.5 * peak GROUP BY ALL),
me AS (SELECT ce.*, w, row_number() OVER (PARTITION BY session_id ORDER BY w) AS rn, count(*) OVER (PARTITION BY session_id) AS size FROM ce JOIN wd USING (session_id) WHERE abs(w - center) <= 1),
fs AS (SELECT session_id, center, observation_count, w AS full_width, size AS cluster_support FROM me WHERE rn = size // 2 + 1)"""


def _widths(spark, folder):
    return signals(spark, folder).select("session_id", "event_id", "t_ms", F.round(60 + F.col("k") % 12 + F.col("event_id") % 100 / 100.0, 2).alias("w"))


@query("full_scale_cluster", f"WITH {SIGNAL_SQL}, {_FULL_SQL} SELECT * FROM fs")
def full_scale_cluster(spark, folder):
    return ops.full_scale(_widths(spark, folder), ["session_id"], "w")


@query("calibrated_percent", f"""
WITH {SIGNAL_SQL}, {_FULL_SQL}
SELECT s.session_id, s.event_id, round(greatest(0.0, least(100.0, 100.0 * round(CAST(60 + k % 12 + (event_id % 100) / 100.0 AS DOUBLE), 2) / full_width)), 6) AS percent FROM sig s JOIN fs USING (session_id)""")
def calibrated_percent(spark, folder):
    rows = _widths(spark, folder)
    scale = ops.full_scale(rows, ["session_id"], "w").select("session_id", "full_width")
    return rows.join(scale, "session_id").select("session_id", "event_id", F.round(clamp(100.0 * F.col("w") / F.col("full_width"), 0.0, 100.0), 6).alias("percent"))


@query("confirmed_gains", f"""
WITH {SIGNAL_SQL}, g AS (SELECT session_id, event_id, t_ms, t_ms // 30000 AS v, event_type <> 'error' AS usable, 0 AS seg, (event_id * 7 % 10) / 10.0 + 0.5 AS conf FROM sig),
n AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv, lag(usable) OVER w AS pu, lead(usable) OVER w AS nu, lag(t_ms) OVER w AS pt, lead(t_ms) OVER w AS nt, lag(conf) OVER w AS pc
  FROM g WINDOW w AS ({_W}))
SELECT session_id, event_id, t_ms, pt AS time_lower_ms, v - pv AS quantity, nt AS confirmed_at_ms FROM n
WHERE usable AND pu AND nu AND t_ms - pt BETWEEN 1 AND 20000 AND nt - t_ms BETWEEN 1 AND 20000 AND least(pc, conf) >= 0.8 AND nv = v AND v > pv""")
def confirmed_gains(spark, folder):
    rows = signals(spark, folder).select("session_id", "event_id", "t_ms", F.expr("t_ms div 30000").alias("v"), (F.col("event_type") != "error").alias("usable"),
                                         F.lit(0).alias("segment"), (F.col("event_id") * 7 % 10 / 10.0 + 0.5).alias("conf"))
    return ops.confirmed_gains(rows, time_order(rows), "v", "usable", "segment", "conf", max_gap_ms=20_000)


@query("isolation", f"""
WITH {SIGNAL_SQL}, p AS (SELECT session_id, event_id, t_ms FROM sig WHERE event_type = 'click'),
n AS (SELECT *, coalesce(t_ms - lag(t_ms) OVER w, 1000000) AS previous_gap, coalesce(lead(t_ms) OVER w - t_ms, 1000000) AS next_gap FROM p WINDOW w AS ({_W}))
SELECT *, previous_gap > 5000 AND next_gap > 5000 AS isolated FROM n""")
def isolation(spark, folder):
    rows = signals(spark, folder).filter("event_type = 'click'").select("session_id", "event_id", "t_ms")
    return ops.isolation(rows, time_order(rows), "t_ms", 5_000)


_POINT_SQL = f"""
pt AS (SELECT session_id, event_id, t_ms // 20000 * 20000 AS t_ms, k % 2 AS hud_level, round(CAST(k // 50 * 50 AS DOUBLE), 4) AS progress,
   CASE WHEN event_type = 'signup' THEN 'level_start' END AS anchor FROM sig),
pr AS (SELECT *, CASE WHEN (t_ms, hud_level, progress) IS DISTINCT FROM lag((t_ms, hud_level, progress)) OVER ({_W}) THEN 1 ELSE 0 END AS f FROM pt),
pu AS (SELECT *, sum(f) OVER ({_W}) AS run FROM pr),
pd AS (SELECT session_id, event_id, t_ms, hud_level, progress, anchor FROM pu
   QUALIFY row_number() OVER (PARTITION BY session_id, run ORDER BY (anchor IS NULL), CASE WHEN anchor IS NULL THEN event_id ELSE -event_id END) = 1)"""


def progress_points(spark, folder):
    return signals(spark, folder).select(
        "session_id", "event_id", F.expr("t_ms div 20000 * 20000").alias("t_ms"), (F.col("k") % 2).alias("hud_level"),
        F.expr("double(k div 50 * 50)").alias("progress"), F.when(F.col("event_type") == "signup", "level_start").alias("anchor"))


@query("dedupe_points_break", f"""
WITH {SIGNAL_SQL}, {_POINT_SQL}, b AS (SELECT *, lag(hud_level) OVER w AS pl, lag(t_ms) OVER w AS ptm, lag(progress) OVER w AS pp FROM pd WINDOW w AS ({_W}))
SELECT session_id, event_id, t_ms, hud_level, progress, anchor, coalesce(hud_level <> pl OR t_ms - ptm > 20000 OR progress < pp - 25, TRUE) AS break_before FROM b""")
def dedupe_points_break(spark, folder):
    rows = progress_points(spark, folder)
    kept = ops.distinct_points(rows, time_order(rows), ["t_ms", "hud_level", "progress"], "anchor")
    return ops.break_flags(kept, time_order(kept), "hud_level", "progress", gap_ms=20_000)


_HOLD_SQL = f"""
mi AS (SELECT session_id, min(start_ms) AS s, max(end_ms) AS e FROM sg GROUP BY session_id, g),
cg AS (SELECT DISTINCT session_id, t_ms FROM sig WHERE event_type = 'click' AND k >= 60),
cu AS (SELECT session_id, s, e, s AS cut FROM mi UNION ALL SELECT mi.session_id, s, e, t_ms FROM mi JOIN cg ON cg.session_id = mi.session_id AND t_ms > s AND t_ms < e),
ho AS (SELECT *, coalesce(lead(cut) OVER (PARTITION BY session_id, s ORDER BY cut), e) AS stop FROM cu),
sv AS (SELECT session_id, t_ms, arg_max(k % 9, event_id) AS hud_level, arg_max(value, event_id) AS progress FROM sig WHERE event_type = 'view' GROUP BY ALL)"""


def _progress(rows):
    return rows.filter("event_type = 'view'").select("session_id", "event_id", "t_ms", (F.col("k") % 9).alias("hud_level"), F.col("value").alias("progress"))


@query("interruption_holds", f"""
WITH {SIGNAL_SQL}, {_SPAN_SQL}, {merged_sql()}, {_HOLD_SQL}
SELECT ho.session_id, cut AS start_ms, stop AS end_ms, hud_level, progress FROM ho ASOF JOIN sv ON ho.session_id = sv.session_id AND ho.cut >= sv.t_ms""")
def interruption_holds(spark, folder):
    rows = signals(spark, folder)
    merged = intervals.merge_overlapping(blocking_spans(spark, folder))
    changes = rows.filter("event_type = 'click' AND k >= 60").select("session_id", "t_ms", "event_id")
    return ops.interruption_holds(_progress(rows), changes, merged, level="hud_level", progress="progress")


@query("interruption_points", f"""
WITH {SIGNAL_SQL}, {_SPAN_SQL}, {merged_sql()}, {_HOLD_SQL}
SELECT session_id, event_id, t_ms FROM sig p WHERE event_type = 'view' AND (k % 10 = 0 OR NOT EXISTS (SELECT 1 FROM mi WHERE mi.session_id = p.session_id AND s < p.t_ms AND p.t_ms < e))""")
def interruption_points(spark, folder):
    rows = signals(spark, folder).filter("event_type = 'view'").select("session_id", "event_id", "t_ms", "k")
    merged = intervals.merge_overlapping(blocking_spans(spark, folder))
    return ops.points_outside(rows, merged, F.col("k") % 10 == 0).drop("k")


@query("interruption_bridges", f"""
WITH {SIGNAL_SQL}, {_SPAN_SQL}, {merged_sql()}, {_HOLD_SQL}
SELECT session_id, event_id, t_ms AS start_ms, t_ms + 3000 AS end_ms FROM sig p WHERE event_type = 'click'
 AND NOT EXISTS (SELECT 1 FROM mi WHERE mi.session_id = p.session_id AND s < p.t_ms + 3000 AND e > p.t_ms)""")
def interruption_bridges(spark, folder):
    """Lower-reliability bridges survive only where no interruption overlaps them."""
    rows = signals(spark, folder).filter("event_type = 'click'").select("session_id", "event_id", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 3_000).alias("end_ms"))
    return ops.segments_outside(rows, intervals.merge_overlapping(blocking_spans(spark, folder)), tie="event_id")


_BRIDGE_SQL = f"""
bp AS (SELECT session_id, event_id, t_ms, k % 3 AS lv, value AS pr FROM sig WHERE event_type = 'purchase'),
bn AS (SELECT *, lead(t_ms) OVER w AS t2, lead(lv) OVER w AS l2, lead(pr) OVER w AS p2 FROM bp WINDOW w AS ({_W}))"""


@query("less_reliable_bridges", f"""
WITH {SIGNAL_SQL}, {_BRIDGE_SQL}
SELECT b.session_id, b.t_ms AS start_ms, b.t2 AS end_ms, b.lv AS hud_level, count(*) AS measured FROM bn b
JOIN sig m ON m.session_id = b.session_id AND m.event_type = 'view' AND m.k <= 80 AND m.t_ms > b.t_ms AND m.t_ms < b.t2
WHERE b.l2 = b.lv AND b.t2 - b.t_ms > 2000 AND b.p2 >= b.pr GROUP BY ALL""")
def less_reliable_bridges(spark, folder):
    """Same-level gaps between reliable points that at least one measured sample fills."""
    from sessionlake.operators.timejoin import asof

    rows = signals(spark, folder)
    points = rows.filter("event_type = 'purchase'").select("session_id", "event_id", "t_ms", (F.col("k") % 3).alias("lv"), F.col("value").alias("pr"))
    order = time_order(points)
    d = order.untag(order.frames(order.tag(points), 1, t2=lambda w: F.lead("t_ms").over(w), l2=lambda w: F.lead("lv").over(w), p2=lambda w: F.lead("pr").over(w)))
    measured = rows.filter("event_type = 'view' AND k <= 80").select("session_id", "t_ms", "event_id")
    d = asof(measured, d, ["event_id", "t_ms", "lv", "pr", "t2", "l2", "p2"], prefix="g_", strict=True)
    d = d.filter("t_ms < g_t2 AND g_l2 = g_lv AND g_t2 - g_t_ms > 2000 AND g_p2 >= g_pr")
    return d.groupBy("session_id", F.col("g_t_ms").alias("start_ms"), F.col("g_t2").alias("end_ms"), F.col("g_lv").alias("hud_level")).agg(F.count(F.lit(1)).alias("measured"))


@query("level_reconciliation", f"""
WITH {SIGNAL_SQL}, c AS (SELECT session_id, t_ms FROM sig WHERE event_type = 'signup' AND k >= 20),
n AS (SELECT session_id, count(*) AS done FROM c GROUP BY ALL),
o AS (SELECT session_id, count(*) AS seen, arg_min(k % 4, t_ms * 1000000000 + event_id) AS frm FROM sig WHERE event_type = 'purchase' AND k >= 30 GROUP BY ALL),
p AS (SELECT session_id, event_id, t_ms, k % 6 AS lv FROM sig WHERE event_type = 'view'),
l AS (SELECT session_id, min(lv) AS low FROM p GROUP BY ALL),
f AS (SELECT l.session_id, coalesce(done, 0) > coalesce(seen, 0) AS reconciled, coalesce(frm, low, 1) AS init FROM l LEFT JOIN n USING (session_id) LEFT JOIN o USING (session_id))
SELECT p.session_id, p.event_id, p.t_ms, reconciled, CASE WHEN reconciled THEN init + (SELECT count(*) FROM c WHERE c.session_id = p.session_id AND c.t_ms <= p.t_ms) ELSE lv END AS hud_level
FROM p JOIN f USING (session_id)""")
def level_reconciliation(spark, folder):
    rows = signals(spark, folder)
    points = rows.filter("event_type = 'view'").select("session_id", "event_id", "t_ms", (F.col("k") % 6).alias("hud_level"))
    completions = rows.filter("event_type = 'signup' AND k >= 20").select("session_id", "event_id", "t_ms")
    changes = rows.filter("event_type = 'purchase' AND k >= 30").select("session_id", "event_id", "t_ms", (F.col("k") % 4).alias("from_level"))
    return ops.levels_from_selections(points, completions, changes, level="hud_level")


@query("consecutive_levels")
def consecutive_levels(spark, folder):
    rows = signals(spark, folder).filter("event_type IN ('click', 'view')").select(
        "session_id", "event_id", "t_ms", F.when(F.col("event_type") == "click", F.expr("t_ms div 60000 + 1 + k % 2")).alias("from_level"),
        F.expr("t_ms div 60000 + 2 + k % 2").alias("to_level"))
    return ops.accepted_levels(rows, time_order(rows), 1)


_INCREASE_SQL = f"""
inc AS (SELECT bar.*, gu.guarded, coalesce(pixels > 1 AND p1 <= 1 AND seen >= pixels - 1, FALSE) AS reappeared FROM
  (SELECT *, lag(pixels) OVER w AS p1, last_value(CASE WHEN pixels > 1 THEN pixels END IGNORE NULLS) OVER (w ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING) AS seen FROM bar WINDOW w AS ({_W})) bar
  JOIN (SELECT session_id, event_id, k >= 97 AS guarded FROM bar) gu USING (session_id, event_id)),
ln AS (SELECT *, CASE WHEN hud >= 0.86 AND quality >= 0.72 AND overlay < 0.05 AND NOT reappeared THEN pixels END AS later FROM inc),
ab AS (SELECT *, lag(pixels) OVER w AS ap, lag(quality) OVER w AS aq, lag(hud) OVER w AS ah, lag(overlay) OVER w AS ao, lag(health_bar) OVER w AS ab, lag(guarded) OVER w AS ag,
  lag(reappeared) OVER w AS ar, first_value(later IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS nx, pixels >= 98 AS fl FROM ln WINDOW w AS ({_W})),
jd AS (SELECT *, ah >= 0.86 AND aq >= 0.72 AND (ao < 0.05 OR (fl AND health_bar AND ab)) AND hud >= 0.86 AND quality >= 0.72 AND (overlay < 0.05 OR (fl AND health_bar AND ab)) AS ordinary,
  ap < 3 AND health_bar AND ab AND ah >= 0.86 AND hud >= 0.86 AND quality >= 0.72 AND ao < 0.30 AND overlay < 0.30 AS low_fill FROM ab)"""


@query("persistent_increases", f"""
WITH {_BAR_SQL}, {_INCREASE_SQL}
SELECT session_id, event_id, t_ms, pixels - ap AS delta_pixels, fl AS saturated, CASE WHEN ordinary THEN 'ordinary_persistent_xp_increase' ELSE 'low_fill_xp_increase' END AS detection_reason
FROM jd WHERE pixels - ap >= 1 AND NOT (ap <= 1 AND fl) AND NOT (guarded OR ag OR reappeared OR ar) AND (ordinary OR low_fill) AND NOT coalesce(nx < pixels - 1, FALSE)""")
def persistent_increases(spark, folder):
    rows = bar_frames(spark, folder).select("session_id", "t_ms", "event_id", "pixels", "quality", "hud", "overlay", "health_bar", (F.col("k") >= 97).alias("guarded"))
    rows = counter_ops.reappearances(rows, time_order(rows), "pixels")
    return ops.bar_increases(rows, time_order(rows), bar_width=100, min_quality=0.72, hud_floor=0.86)


_RESET_SQL = f"""
rb AS (SELECT *, (session_id % 2 = 0 AND ((t_ms // 1000) % 100 >= 84 OR (t_ms // 1000) % 100 < 16)) AS paused, row_number() OVER w AS frame, lag(pixels) OVER w AS p1,
  last_value(CASE WHEN pixels > 1 THEN pixels END IGNORE NULLS) OVER (w ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING) AS seen, max(pixels) OVER (PARTITION BY session_id) AS width,
  max(pixels) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS before, median(pixels) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS after FROM bar WINDOW w AS ({_W})),
rg AS (SELECT *, paused OR k >= 97 AS guarded, coalesce(pixels > 1 AND p1 <= 1 AND seen >= pixels - 1, FALSE) AS reappeared FROM rb),
rl AS (SELECT *, quality >= 0.72 AND overlay < 0.05 AND NOT guarded AS clean, hud >= 0.86 AS readable FROM rg),
rp AS (SELECT *, lag(clean) OVER w AS c1, lag(readable) OVER w AS r1 FROM rl WINDOW w AS ({_W})),
grown AS (SELECT session_id, frame FROM rp WHERE readable AND r1 AND clean AND c1 AND pixels > p1 AND NOT reappeared),
cand AS (SELECT session_id, event_id, frame, (SELECT max(g.frame) FROM grown g WHERE g.session_id = rp.session_id AND g.frame < rp.frame) AS g,
  coalesce((SELECT max(o.frame) FROM rp o WHERE o.session_id = rp.session_id AND o.frame < rp.frame AND NOT o.paused), 0) + 1 AS b
  FROM rp WHERE readable AND r1 AND pixels - p1 <= CAST(-0.2 AS DOUBLE) * width AND before >= CAST(0.9 AS DOUBLE) * width AND after <= CAST(0.8 AS DOUBLE) * width),
nx AS (SELECT a.session_id, a.frame, min(z.frame) AS nxt FROM cand a JOIN cand z ON z.session_id = a.session_id AND z.frame > a.b + 6 AND z.g > a.b GROUP BY ALL),
walk AS (SELECT session_id, min(frame) AS frame FROM cand GROUP BY session_id UNION ALL SELECT nx.session_id, nx.nxt FROM walk JOIN nx USING (session_id, frame))"""


@query("level_resets", f"""
WITH RECURSIVE {_BAR_SQL}, {_RESET_SQL}
SELECT session_id, b AS frame, s.t_ms, s.event_id, cand.event_id AS fall_event_id FROM walk JOIN cand USING (session_id, frame) JOIN (SELECT session_id, frame AS b, t_ms, event_id FROM rb) s USING (session_id, b)""")
def level_resets(spark, folder):
    """Bar resets: a large fall with a nearly full bar before and a low one after, after renewed activity, dated back to the pause it ends."""
    second = F.expr("(t_ms div 1000) % 100")
    paused = (F.col("session_id") % 2 == 0) & ((second >= 84) | (second < 16))
    rows = bar_frames(spark, folder).select("session_id", "t_ms", "event_id", "pixels", "quality", "hud", "overlay", paused.alias("paused"), (paused | (F.col("k") >= 97)).alias("guarded"))
    order = time_order(rows)
    return counter_ops.bar_resets(counter_ops.reappearances(rows, order, "pixels"), order, hud_floor=0.86, min_quality=0.72, collapse_frames=6)


@query("reset_levels", f"""
WITH {SIGNAL_SQL}, r AS (SELECT session_id, t_ms FROM sig WHERE event_type = 'signup' AND k % 5 = 0)
SELECT s.session_id, s.event_id, 1 + (SELECT count(*) FROM r WHERE r.session_id = s.session_id AND r.t_ms < s.t_ms) AS inferred_level FROM sig s WHERE event_type = 'click'""")
def reset_levels(spark, folder):
    """Level of a pickup: the initial level plus the resets strictly before it."""
    from sessionlake.operators.ordering import running_sum
    from sessionlake.operators.timejoin import stream_join

    rows = signals(spark, folder)
    clicks = rows.filter("event_type = 'click'").select("session_id", "t_ms", "event_id")
    resets = rows.filter("event_type = 'signup' AND k % 5 = 0").select("session_id", "t_ms", "event_id")
    d = stream_join(clicks, resets, {"n": running_sum(F.when(F.col("_right").isNotNull(), 1).otherwise(0).cast("long"))}, right_first=False)
    return d.select("session_id", "event_id", (F.col("n") + 1).alias("inferred_level"))


@query("transition_invariants", f"""
WITH {SIGNAL_SQL}, e AS (SELECT session_id, event_id, t_ms // 4000 AS frame, event_type = 'signup' AS boundary, k < 10 AS guarded FROM sig WHERE event_type IN ('click', 'signup')),
r AS (SELECT DISTINCT session_id, t_ms // 4000 AS frame FROM sig WHERE event_type = 'signup' AND k % 4 <> 0),
b AS (SELECT session_id, frame, count(*) AS n, min(event_id) AS id FROM e WHERE boundary GROUP BY ALL)
SELECT session_id, frame, 'event_touches_transition' AS violation, event_id FROM e WHERE NOT boundary AND guarded
UNION ALL SELECT session_id, frame, 'duplicate_boundary', id FROM b WHERE n > 1
UNION ALL SELECT session_id, frame, 'unexpected_boundary', id FROM b ANTI JOIN r USING (session_id, frame)
UNION ALL SELECT session_id, frame, 'missing_boundary', NULL FROM r ANTI JOIN b USING (session_id, frame)""")
def transition_invariants(spark, folder):
    """Violations: pickups that touch a guarded frame, and boundaries that do not match the resets one to one."""
    rows = signals(spark, folder)
    frame = F.expr("t_ms div 4000").alias("frame")
    events = rows.filter("event_type IN ('click', 'signup')").select("session_id", "event_id", frame, (F.col("event_type") == "signup").alias("boundary"), (F.col("k") < 10).alias("guarded"))
    resets = rows.filter("event_type = 'signup' AND k % 4 <> 0").select("session_id", frame).distinct()
    bounds = events.filter("boundary").groupBy("session_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id"))
    on = ["session_id", "frame"]
    shape = lambda df, name: df.select("session_id", "frame", F.lit(name).alias("violation"), "event_id")
    return (shape(events.filter("NOT boundary AND guarded"), "event_touches_transition")
            .unionByName(shape(bounds.filter("n > 1"), "duplicate_boundary"))
            .unionByName(shape(bounds.join(resets, on, "left_anti"), "unexpected_boundary"))
            .unionByName(shape(resets.join(bounds, on, "left_anti").withColumn("event_id", F.lit(None).cast("long")), "missing_boundary")))
