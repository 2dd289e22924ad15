"""Joins between event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.operators import timejoin as ops
from sessionlake.operators.ordering import last_seen, running_sum, time_order
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import COUNTER_SQL, SIGNAL_SQL, counters, signals, table

_W = "PARTITION BY session_id ORDER BY t_ms, event_id"


def _only(rows, kind: str):
    return rows.filter(F.col("event_type") == kind)


@query("asof_state", f"""
WITH {COUNTER_SQL}, r AS (SELECT session_id, t_ms, arg_max(c, event_id) AS c, max(event_id) AS source_id FROM cnt WHERE event_type = 'purchase' GROUP BY ALL)
SELECT l.session_id, l.event_id, r.c AS counter, r.t_ms AS state_ms, r.source_id
FROM (SELECT * FROM cnt WHERE event_type = 'click') l ASOF LEFT JOIN r ON l.session_id = r.session_id AND l.t_ms >= r.t_ms""")
def asof_state(spark, folder):
    rows = counters(spark, folder)
    left = _only(rows, "click").select("session_id", "t_ms", "event_id")
    right = _only(rows, "purchase").select("session_id", "t_ms", "event_id", "c")
    return ops.asof(left, right, ["c", "t_ms", "event_id"], prefix="s_").select(
        "session_id", "event_id", F.col("s_c").alias("counter"), F.col("s_t_ms").alias("state_ms"), F.col("s_event_id").alias("source_id"))


@query("asof_forward", f"""
WITH {SIGNAL_SQL}, r AS (SELECT session_id, t_ms, arg_min(k, event_id) AS k FROM sig WHERE event_type = 'signup' GROUP BY ALL)
SELECT l.session_id, l.event_id, r.k AS level_after, r.t_ms AS level_ms
FROM (SELECT * FROM sig WHERE event_type = 'view') l ASOF LEFT JOIN r ON l.session_id = r.session_id AND l.t_ms <= r.t_ms""")
def asof_forward(spark, folder):
    rows = signals(spark, folder)
    left = _only(rows, "view").select("session_id", "t_ms", "event_id")
    right = _only(rows, "signup").select("session_id", "t_ms", "event_id", "k")
    return ops.asof(left, right, ["k", "t_ms"], prefix="s_", forward=True).select(
        "session_id", "event_id", F.col("s_k").alias("level_after"), F.col("s_t_ms").alias("level_ms"))


@query("asof_owned_level", f"""
WITH {SIGNAL_SQL}, i AS (SELECT session_id, t_ms, event_id, event_type, k % 5 AS item, k // 5 AS level FROM sig),
r AS (SELECT session_id, item, t_ms, max(level) AS level FROM i WHERE event_type = 'purchase' GROUP BY ALL)
SELECT l.session_id, l.event_id, l.item, r.level AS owned_level
FROM (SELECT * FROM i WHERE event_type = 'click') l ASOF LEFT JOIN r ON l.session_id = r.session_id AND l.item = r.item AND l.t_ms > r.t_ms""")
def asof_owned_level(spark, folder):
    """Level of the item strictly before the menu; at one instant the higher level counts."""
    rows = signals(spark, folder).select("session_id", "t_ms", "event_id", "event_type", (F.col("k") % 5).alias("item"), F.expr("k div 5").alias("level"))
    left = _only(rows, "click").select("session_id", "t_ms", "event_id", "item")
    right = _only(rows, "purchase").select("session_id", "t_ms", "event_id", "item", "level")
    return ops.asof(left, right, ["level"], prefix="owned_", strict=True, keys=["session_id", "item"], right_tie="level").drop("t_ms")


@query("asof_attributes", f"""
WITH {SIGNAL_SQL}, i AS (SELECT *, k % 4 AS item, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'slot_' || (k % 6) END AS slot,
   CASE WHEN event_id % 4 = 0 THEN NULL ELSE k END AS lvl FROM sig)
SELECT session_id, event_id, item, coalesce(last_value(slot IGNORE NULLS) OVER (PARTITION BY session_id, item ORDER BY t_ms, event_id), 'unresolved') AS slot,
   last_value(lvl IGNORE NULLS) OVER ({_W}) AS character_level FROM i""")
def asof_attributes(spark, folder):
    """Latest readable slot of the same item and latest character level of the session."""
    rows = signals(spark, folder).select("session_id", "t_ms", "event_id", (F.col("k") % 4).alias("item"), F.expr(
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('slot_', k % 6) END").alias("raw_slot"), F.expr("CASE WHEN event_id % 4 = 0 THEN NULL ELSE k END").alias("lvl"))
    by_item = time_order(rows, ("session_id", "item"))
    d = by_item.untag(by_item.running(by_item.tag(rows), slot=last_seen(F.col("raw_slot"))))
    order = time_order(rows)
    d = order.untag(order.running(order.tag(d), character_level=last_seen(F.col("lvl"))))
    return d.select("session_id", "event_id", "item", F.coalesce("slot", F.lit("unresolved")).alias("slot"), "character_level")


@query("level_from_completions", f"""
WITH {SIGNAL_SQL}, c AS (SELECT session_id, t_ms FROM sig WHERE event_type = 'signup' AND k >= 40)
SELECT s.session_id, s.event_id, 1 + (SELECT count(*) FROM c WHERE c.session_id = s.session_id AND c.t_ms <= s.t_ms) AS level FROM sig s WHERE event_type <> 'signup'""")
def level_from_completions(spark, folder):
    rows = signals(spark, folder)
    left = rows.filter("event_type <> 'signup'").select("session_id", "t_ms", "event_id")
    right = rows.filter("event_type = 'signup' AND k >= 40").select("session_id", "t_ms", "event_id")
    done = running_sum(F.when(F.col("_right").isNotNull(), 1).otherwise(0).cast("long"))
    return ops.stream_join(left, right, {"done": done}).select("session_id", "event_id", (F.col("done") + 1).alias("level"))


_NEAREST_SQL = """
near AS (SELECT l.session_id, l.event_id, r.event_id AS match_id, abs(l.t_ms - r.t_ms) AS distance_ms
   FROM lft l JOIN rgt r ON l.session_id = r.session_id AND abs(l.t_ms - r.t_ms) <= {tol}
   QUALIFY row_number() OVER (PARTITION BY l.session_id, l.event_id ORDER BY abs(l.t_ms - r.t_ms), r.t_ms, r.event_id) = 1)"""


@query("nearest_within", f"""
WITH {SIGNAL_SQL}, lft AS (SELECT * FROM sig WHERE event_type = 'click'), rgt AS (SELECT * FROM sig WHERE event_type = 'purchase'), {_NEAREST_SQL.format(tol=2500)}
SELECT l.session_id, l.event_id, match_id, distance_ms FROM lft l LEFT JOIN near USING (session_id, event_id)""")
def nearest_within(spark, folder):
    rows = signals(spark, folder)
    left = _only(rows, "click").select("session_id", "t_ms", "event_id")
    right = _only(rows, "purchase").select("session_id", "t_ms", F.col("event_id").alias("match_id"))
    return ops.nearest(left, right, ["match_id"], 2_500, right_tie="match_id").drop("t_ms")


@query("nearest_timeline_row", f"""
WITH {SIGNAL_SQL}, lft AS (SELECT session_id, min(t_ms) + 30000 AS t_ms, session_id AS event_id FROM sig GROUP BY ALL),
rgt AS (SELECT * FROM sig WHERE event_type = 'view'), {_NEAREST_SQL.format(tol=10_000_000)}
SELECT session_id, match_id, distance_ms FROM near""")
def nearest_timeline_row(spark, folder):
    rows = signals(spark, folder)
    openings = rows.groupBy("session_id").agg((F.min("t_ms") + 30_000).alias("t_ms")).withColumn("event_id", F.col("session_id"))
    right = _only(rows, "view").select("session_id", "t_ms", F.col("event_id").alias("match_id"))
    return ops.nearest(openings, right, ["match_id"], 10_000_000, right_tie="match_id").filter("match_id IS NOT NULL").select(
        "session_id", "match_id", "distance_ms")


@query("corroborate_nearest", f"""
WITH {SIGNAL_SQL}, lft AS (SELECT * FROM sig WHERE event_type = 'view' AND k >= 10), rgt AS (SELECT * FROM sig WHERE event_type = 'signup' AND k % 2 = 0), {_NEAREST_SQL.format(tol=2000)}
SELECT l.session_id, l.event_id, CASE WHEN k % 2 = 0 AND match_id IS NOT NULL THEN 'floor_chicken' WHEN k % 2 = 0 THEN 'abrupt_healing_effect' ELSE 'currency_gain' END AS event_type,
  CASE WHEN k % 2 = 0 AND match_id IS NOT NULL THEN 'B' ELSE 'C' END AS evidence_grade,
  CASE WHEN k % 2 = 0 AND match_id IS NOT NULL THEN 'auto_accepted' ELSE 'needs_review' END AS publication_status,
  CASE WHEN k % 2 = 0 THEN match_id END AS corroborating_id FROM lft l LEFT JOIN near USING (session_id, event_id)""")
def corroborate_nearest(spark, folder):
    """An effect gets an identity only when a matching sprite candidate lies close to it."""
    rows = signals(spark, folder)
    effects = rows.filter("event_type = 'view' AND k >= 10").select("session_id", "t_ms", "event_id", (F.col("k") % 2 == 0).alias("healing"))
    sprites = rows.filter("event_type = 'signup' AND k % 2 = 0").select("session_id", "t_ms", F.col("event_id").alias("sprite_id"))
    d = ops.nearest(effects, sprites, ["sprite_id"], 2_000, right_tie="sprite_id")
    promoted = F.col("healing") & F.col("sprite_id").isNotNull()
    return d.select("session_id", "event_id",
                    F.when(promoted, "floor_chicken").when(F.col("healing"), "abrupt_healing_effect").otherwise("currency_gain").alias("event_type"),
                    F.when(promoted, "B").otherwise("C").alias("evidence_grade"),
                    F.when(promoted, "auto_accepted").otherwise("needs_review").alias("publication_status"),
                    F.when(F.col("healing"), F.col("sprite_id")).alias("corroborating_id"))


_ATTRIBUTION_SQL = """
rec AS (SELECT session_id, t_ms, event_id, value / 6 AS quantity FROM sig WHERE event_type = 'view'),
inv AS (SELECT session_id, t_ms, event_id, CASE WHEN event_type = 'signup' THEN 'floor_chicken' WHEN event_type = 'purchase' AND k % 3 = 0 THEN 'regeneration_item'
   WHEN event_type = 'click' THEN 'level_up_transaction' END AS kind, CASE WHEN k >= 50 THEN 'A' ELSE 'B' END AS grade FROM sig WHERE k >= 20 AND event_type <> 'view'),
ck AS (SELECT session_id, t_ms, min(event_id) AS id, arg_min(grade, event_id) AS grade FROM inv WHERE kind = 'floor_chicken' GROUP BY ALL),
rg AS (SELECT session_id, t_ms, min(event_id) AS id FROM inv WHERE kind = 'regeneration_item' GROUP BY ALL),
mn AS (SELECT r.session_id, r.event_id, m.event_id AS id, r.t_ms - m.t_ms AS lat FROM rec r JOIN inv m ON m.session_id = r.session_id AND m.kind = 'level_up_transaction'
   AND abs(r.t_ms - m.t_ms) <= 2000 QUALIFY row_number() OVER (PARTITION BY r.session_id, r.event_id ORDER BY abs(r.t_ms - m.t_ms), m.t_ms, m.event_id) = 1),
j AS (SELECT rec.*, ck.id AS cid, ck.grade AS cgrade, rec.t_ms - ck.t_ms AS clat, rg.id AS gid, rec.t_ms - rg.t_ms AS glat, mn.id AS mid, mn.lat AS mlat FROM rec
   ASOF LEFT JOIN ck ON rec.session_id = ck.session_id AND rec.t_ms >= ck.t_ms ASOF LEFT JOIN rg ON rec.session_id = rg.session_id AND rec.t_ms >= rg.t_ms
   LEFT JOIN mn ON mn.session_id = rec.session_id AND mn.event_id = rec.event_id)"""


@query("recovery_attribution", f"""
WITH {SIGNAL_SQL}, {_ATTRIBUTION_SQL}
SELECT session_id, event_id, CASE WHEN clat <= 5000 THEN 'floor_chicken_temporal_match' WHEN gid IS NOT NULL AND quantity <= 8 THEN 'compatible_regeneration'
  WHEN mid IS NOT NULL THEN 'unresolved_near_level_up_menu' WHEN quantity <= 8 THEN 'gradual_regeneration_candidate' ELSE 'unresolved_recovery_source' END AS cause_code,
  CASE WHEN clat <= 5000 THEN cgrade WHEN gid IS NOT NULL AND quantity <= 8 THEN 'B' WHEN mid IS NOT NULL THEN 'unresolved' WHEN quantity <= 8 THEN 'C' ELSE 'unresolved' END AS evidence_grade,
  CASE WHEN clat <= 5000 THEN clat WHEN gid IS NOT NULL AND quantity <= 8 THEN glat ELSE mlat END AS latency_ms,
  CASE WHEN clat <= 5000 THEN cid WHEN gid IS NOT NULL AND quantity <= 8 THEN gid ELSE mid END AS source_event_id FROM j""")
def recovery_attribution(spark, folder):
    """First rule that holds: recent reward, earlier regeneration item, nearby menu, pattern only, unresolved."""
    rows = signals(spark, folder)
    recoveries = _only(rows, "view").select("session_id", "t_ms", "event_id", (F.col("value") / 6).alias("quantity"))
    eligible = rows.filter("k >= 20 AND event_type <> 'view'").withColumn("grade", F.when(F.col("k") >= 50, "A").otherwise("B"))
    pick = lambda condition, *cols: eligible.filter(condition).select("session_id", "t_ms", F.col("event_id").alias("id"), *cols)
    earliest = lambda df, *cols: df.groupBy("session_id", "t_ms").agg(F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in cols])
    rewards = earliest(pick("event_type = 'signup'", "grade"), "grade")
    items = earliest(pick("event_type = 'purchase' AND k % 3 = 0"))
    menus = pick("event_type = 'click'")
    d = ops.asof(recoveries, rewards, ["id", "grade", "t_ms"], prefix="c_", right_tie="id")
    d = ops.asof(d, items, ["id", "t_ms"], prefix="g_", right_tie="id")
    d = ops.nearest(d, menus, ["id", "t_ms"], 2_000, prefix="m_", right_tie="id", distance="m_gap")
    reward = F.coalesce(F.col("t_ms") - F.col("c_t_ms") <= 5_000, F.lit(False))
    small = F.col("quantity") <= 8
    item = F.col("g_id").isNotNull() & small
    menu = F.col("m_id").isNotNull()
    rule = lambda a, b, c, d_, e: F.when(reward, a).when(item, b).when(menu, c).when(small, d_).otherwise(e)
    none = F.lit(None)
    return d.select(
        "session_id", "event_id",
        rule("floor_chicken_temporal_match", "compatible_regeneration", "unresolved_near_level_up_menu", "gradual_regeneration_candidate", "unresolved_recovery_source").alias("cause_code"),
        rule(F.col("c_grade"), "B", "unresolved", "C", "unresolved").alias("evidence_grade"),
        rule(F.col("t_ms") - F.col("c_t_ms"), F.col("t_ms") - F.col("g_t_ms"), F.col("t_ms") - F.col("m_t_ms"), none, none).alias("latency_ms"),
        rule(F.col("c_id"), F.col("g_id"), F.col("m_id"), none, none).alias("source_event_id"))


@query("unique_pairing", f"""
WITH {SIGNAL_SQL}, e AS (SELECT session_id, event_id, t_ms AS entry, t_ms + 2000 + k * 20 AS pred FROM sig WHERE event_type = 'click'),
x AS (SELECT session_id, event_id, t_ms FROM sig WHERE event_type IN ('view', 'purchase')),
c AS (SELECT e.*, x.event_id AS xid, x.t_ms AS xt, abs(x.t_ms - pred) AS d FROM e JOIN x ON x.session_id = e.session_id AND x.t_ms BETWEEN greatest(pred - 8000, entry + 100) AND least(pred + 8000, entry + 60000)),
r AS (SELECT *, row_number() OVER w AS rn, lead(d) OVER w AS d2 FROM c WINDOW w AS (PARTITION BY session_id, event_id ORDER BY d, xt, xid))
SELECT e.session_id, e.event_id, CASE WHEN r.d2 - r.d < 3000 THEN NULL ELSE xid END AS match_id, CASE WHEN r.d2 - r.d < 3000 THEN NULL ELSE xt END AS match_time,
  CASE WHEN xid IS NULL THEN 'none' WHEN r.d2 - r.d < 3000 THEN 'ambiguous' ELSE 'assigned' END AS outcome
FROM e LEFT JOIN r ON r.session_id = e.session_id AND r.event_id = e.event_id AND r.rn = 1""")
def unique_pairing(spark, folder):
    rows = signals(spark, folder)
    entries = _only(rows, "click").select("session_id", "event_id", F.col("t_ms").alias("entry"), (F.col("t_ms") + 2_000 + F.col("k") * 20).alias("predicted"))
    targets = rows.filter("event_type IN ('view', 'purchase')").select("session_id", "t_ms", "event_id")
    low = F.greatest(F.col("predicted") - 8_000, F.col("entry") + 100)
    high = F.least(F.col("predicted") + 8_000, F.col("entry") + 60_000)
    return ops.unique_nearest(entries, targets, time="predicted", low=low, high=high, margin=3_000).select(
        "session_id", "event_id", "match_id", "match_time", "outcome")


@query("pairing_diagnostics", f"""
WITH {SIGNAL_SQL}, e AS (SELECT session_id, event_id, t_ms AS entry, t_ms + 2000 + k * 20 AS pred, (k % 40) / 40.0 AS confidence FROM sig WHERE event_type = 'click'),
x AS (SELECT session_id, event_id, t_ms FROM sig WHERE event_type IN ('view', 'purchase')),
c AS (SELECT e.*, abs(x.t_ms - pred) AS d, x.t_ms AS xt, x.event_id AS xid FROM e JOIN x ON x.session_id = e.session_id AND x.t_ms BETWEEN greatest(pred - 8000, entry + 100) AND least(pred + 8000, entry + 60000)),
r AS (SELECT *, row_number() OVER w AS rn, lead(d) OVER w AS d2 FROM c WINDOW w AS (PARTITION BY session_id, event_id ORDER BY d, xt, xid)),
o AS (SELECT CASE WHEN e.confidence < 0.72 THEN 'entry_below_confidence_gate' WHEN r.d IS NULL THEN 'entry_without_compatible_xp_event'
   WHEN r.d2 - r.d < 3000 THEN 'entry_with_ambiguous_xp_event' ELSE 'entry_assigned_to_xp_event' END AS diagnostic
   FROM e LEFT JOIN r ON r.session_id = e.session_id AND r.event_id = e.event_id AND r.rn = 1)
SELECT diagnostic, count(*) AS n FROM o GROUP BY ALL""")
def pairing_diagnostics(spark, folder):
    rows = signals(spark, folder)
    entries = _only(rows, "click").select("session_id", "event_id", F.col("t_ms").alias("entry"), (F.col("t_ms") + 2_000 + F.col("k") * 20).alias("predicted"),
                                          (F.col("k") % 40 / 40.0).alias("confidence"))
    targets = rows.filter("event_type IN ('view', 'purchase')").select("session_id", "t_ms", "event_id")
    low = F.greatest(F.col("predicted") - 8_000, F.col("entry") + 100)
    high = F.least(F.col("predicted") + 8_000, F.col("entry") + 60_000)
    d = ops.unique_nearest(entries, targets, time="predicted", low=low, high=high, margin=3_000)
    label = (F.when(F.col("confidence") < 0.72, "entry_below_confidence_gate").when(F.col("outcome") == "none", "entry_without_compatible_xp_event")
             .when(F.col("outcome") == "ambiguous", "entry_with_ambiguous_xp_event").otherwise("entry_assigned_to_xp_event"))
    return d.groupBy(label.alias("diagnostic")).agg(F.count(F.lit(1)).alias("n"))


@query("containment_parent", f"""
WITH {SIGNAL_SQL}, b AS (SELECT session_id, event_id, t_ms AS s, t_ms + k * 150 AS e FROM sig WHERE event_type = 'signup')
SELECT p.session_id, p.event_id, (SELECT b.event_id FROM b WHERE b.session_id = p.session_id AND p.t_ms BETWEEN b.s AND b.e ORDER BY b.s, b.event_id LIMIT 1) AS parent_id
FROM sig p WHERE p.event_type = 'purchase'""")
def containment_parent(spark, folder):
    rows = signals(spark, folder)
    points = _only(rows, "purchase").select("session_id", "t_ms", "event_id")
    boxes = _only(rows, "signup").select("session_id", F.col("event_id").alias("parent_id"), F.col("t_ms").alias("start_ms"), (F.col("t_ms") + F.col("k") * 150).alias("end_ms"))
    return ops.first_containing(points, boxes, ["parent_id"], interval_tie="parent_id").drop("t_ms")


@query("anti_tolerance", f"""
WITH {SIGNAL_SQL}, p AS (SELECT session_id, event_id, t_ms // 2000 AS anchor, CASE WHEN k % 2 = 0 THEN 'level_up_selection' ELSE 'level_up_transaction' END AS kind,
   CASE WHEN k % 7 = 0 THEN NULL ELSE 'item_' || (k % 3) END AS item FROM sig WHERE event_type = 'click'),
c AS (SELECT session_id, t_ms // 2000 AS anchor, CASE WHEN k % 2 = 0 THEN 'level_up_selection' ELSE 'level_up_transaction' END AS kind,
   CASE WHEN k % 5 = 0 THEN NULL ELSE 'item_' || (k % 3) END AS item, CASE WHEN k % 4 = 1 THEN 'banish' ELSE 'select_reward' END AS action FROM sig WHERE event_type IN ('purchase', 'signup'))
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = p.session_id AND c.kind = p.kind AND abs(c.anchor - p.anchor) <= 1
  AND (p.kind = 'level_up_selection' OR (c.action = 'select_reward' AND (c.item IS NULL OR p.item IS NULL OR c.item = p.item))))""")
def anti_tolerance(spark, folder):
    """Projected inventory events that no canonical event of the same kind already represents."""
    kind = F.when(F.col("k") % 2 == 0, "level_up_selection").otherwise("level_up_transaction")
    rows = signals(spark, folder).withColumns({"kind": kind, "anchor": F.expr("t_ms div 2000")})
    item = lambda divisor: F.when(F.col("k") % divisor != 0, F.concat(F.lit("item_"), (F.col("k") % 3).cast("string")))
    projected = _only(rows, "click").select("session_id", "event_id", "anchor", "kind", item(7).alias("item"))
    canonical = rows.filter("event_type IN ('purchase', 'signup')").select(
        "session_id", "anchor", "kind", item(5).alias("item"), F.when(F.col("k") % 4 == 1, "banish").otherwise("select_reward").alias("action"))
    same = ["session_id", "kind"]
    selections = ops.unmatched_within(projected.filter("kind = 'level_up_selection'"), canonical, 1, equal=same, time="anchor")
    transactions = ops.unmatched_within(projected.filter("kind = 'level_up_transaction'"), canonical.filter("action = 'select_reward'"), 1,
                                        equal=same, time="anchor", item="item")
    return selections.unionByName(transactions)


@query("nearest_clean_sample", f"""
WITH {SIGNAL_SQL}, t AS (SELECT session_id, event_id, t_ms, k >= 50 AS clean FROM sig),
c AS (SELECT a.session_id, a.event_id, b.t_ms AS used, row_number() OVER (PARTITION BY a.session_id, a.event_id ORDER BY abs(b.t_ms - a.t_ms), b.t_ms DESC) AS rn
   FROM t a JOIN t b ON a.session_id = b.session_id AND b.clean AND abs(b.t_ms - a.t_ms) BETWEEN 2000 AND 5000 WHERE NOT a.clean)
SELECT t.session_id, t.event_id, CASE WHEN t.clean THEN t.t_ms ELSE c.used END AS used_ms,
  CASE WHEN t.clean THEN 'gameplay' WHEN c.used IS NOT NULL THEN 'gameplay_near_overlay' ELSE 'overlay_unresolved' END AS screen_state
FROM t LEFT JOIN c ON c.session_id = t.session_id AND c.event_id = t.event_id AND c.rn = 1""")
def nearest_clean_sample(spark, folder):
    rows = signals(spark, folder).select("session_id", "event_id", "t_ms", (F.col("k") >= 50).alias("clean"))
    return ops.nearest_clean(rows, rows, clean="clean").select("session_id", "event_id", "used_ms", "screen_state")


@query("first_later_slot", f"""
WITH {SIGNAL_SQL}, i AS (SELECT session_id, event_id, t_ms, k % 3 AS item, 1 + k % 6 AS slot, event_type FROM sig)
SELECT p.session_id, p.event_id, p.item, (SELECT x.slot FROM i x WHERE x.event_type IN ('view', 'error') AND x.session_id = p.session_id AND x.item = p.item
  AND x.t_ms BETWEEN p.t_ms AND p.t_ms + 10000 ORDER BY x.t_ms, x.slot LIMIT 1) AS slot FROM i p WHERE p.event_type = 'purchase'""")
def first_later_slot(spark, folder):
    """Slot of an item in the first later timeline row within ten seconds that shows it."""
    rows = signals(spark, folder).select("session_id", "event_id", "t_ms", (F.col("k") % 3).alias("item"), (1 + F.col("k") % 6).alias("slot"), "event_type")
    shown = rows.filter("event_type IN ('view', 'error')").groupBy("session_id", "item", "t_ms").agg(F.min("slot").alias("slot"))
    events = _only(rows, "purchase").select("session_id", "event_id", "t_ms", "item")
    d = ops.asof(events, shown, ["slot", "t_ms"], prefix="n_", forward=True, keys=["session_id", "item"], right_tie="slot")
    return d.select("session_id", "event_id", "item", F.when(F.col("n_t_ms") <= F.col("t_ms") + 10_000, F.col("n_slot")).alias("slot"))


# fixed values: catalogue of event codes with their detector support
CATALOGUE = [("click", True), ("view", True), ("purchase", False), ("signup", True), ("error", True), ("trap_triggered", True), ("rosary", True), ("map_found", False)]


@query("coverage_left", """
WITH c(code, supported) AS (VALUES ('click', TRUE), ('view', TRUE), ('purchase', FALSE), ('signup', TRUE), ('error', TRUE), ('trap_triggered', TRUE), ('rosary', TRUE), ('map_found', FALSE)),
n AS (SELECT event_type AS code, count(*) AS n FROM events GROUP BY ALL)
SELECT code AS event_type, CASE WHEN n > 0 THEN 'events_published' WHEN supported THEN 'detector_ran_no_published_event' ELSE 'derived_or_preexisting' END AS status,
       coalesce(n, 0) AS published_count FROM c LEFT JOIN n USING (code)""")
def coverage_left(spark, folder):
    catalogue = spark.createDataFrame(CATALOGUE, "event_type string, supported boolean")
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") > 0, "events_published").when(F.col("supported"), "detector_ran_no_published_event").otherwise("derived_or_preexisting")
    return catalogue.join(counts, "event_type", "left").select("event_type", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("published_count"))


@query("table_diff", """
WITH a AS (SELECT event_id, event_type, value FROM events WHERE event_id % 97 <> 0),
b AS (SELECT event_id, CASE WHEN event_id % 89 = 0 THEN 'other' ELSE event_type END AS event_type, CASE WHEN event_id % 83 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_id % 101 <> 0),
j AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN b.event_id IS NULL THEN 'left_only' WHEN a.event_id IS NULL THEN 'right_only' ELSE 'changed' END AS kind,
  concat_ws('|', CASE WHEN a.event_type IS DISTINCT FROM b.event_type THEN 'event_type' END, CASE WHEN a.value IS DISTINCT FROM b.value THEN 'value' END) AS cols
  FROM a FULL JOIN b ON a.event_id = b.event_id)
SELECT event_id, kind, CASE WHEN kind = 'changed' THEN cols ELSE '' END AS columns FROM j WHERE kind <> 'changed' OR cols <> ''""")
def table_diff(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    old = events.filter("event_id % 97 <> 0")
    new = events.filter("event_id % 101 <> 0").withColumns({
        "event_type": F.when(F.col("event_id") % 89 == 0, "other").otherwise(F.col("event_type")),
        "value": F.when(F.col("event_id") % 83 != 0, F.col("value"))})
    return ops.table_difference(old, new, ["event_id"])


# fixed values: recording parts with their place on the session axis
PARTS = [("1-URGENT", 0, 0, 0, 9_000), ("2-HIGH", 1, 10_000, 10_000, 19_000), ("3-MEDIUM", 3, 20_000, 20_500, 29_000), ("5-LOW", 6, 30_000, 30_000, 39_500)]

_PARTS_SQL = """
parts(part, level_offset, offset_ms, start_ms, end_ms) AS (VALUES ('1-URGENT', 0, 0, 0, 9000), ('2-HIGH', 1, 10000, 10000, 19000), ('3-MEDIUM', 3, 20000, 20500, 29000), ('5-LOW', 6, 30000, 30000, 39500))"""


@query("parts_shift_merge", f"""
WITH {_PARTS_SQL}
SELECT part || '_' || o_orderkey AS event_id, o_custkey AS session_id, o_orderkey % 10000 + offset_ms AS t_ms, o_orderkey % 7 + level_offset AS level
FROM orders JOIN parts ON o_orderpriority = part WHERE o_orderkey % 10000 + offset_ms >= start_ms AND o_orderkey % 10000 + offset_ms < end_ms""")
def parts_shift_merge(spark, folder):
    """Parts on one time axis: shift first, then keep what lies inside the part's window."""
    parts = spark.createDataFrame(PARTS, "part string, level_offset long, offset_ms long, start_ms long, end_ms long")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("part"))
    d = orders.join(F.broadcast(parts), "part").withColumn("t_ms", F.col("o_orderkey") % 10_000 + F.col("offset_ms"))
    return d.filter("t_ms >= start_ms AND t_ms < end_ms").select(
        F.concat_ws("_", "part", F.col("o_orderkey").cast("string")).alias("event_id"), F.col("o_custkey").alias("session_id"), "t_ms",
        (F.col("o_orderkey") % 7 + F.col("level_offset")).alias("level"))


@query("prefix_summary", f"""
WITH {SIGNAL_SQL}
SELECT event_type, count(*) AS rows, count(*) FILTER (t_ms >= 600000) AS outside_prefix, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM sig GROUP BY ALL""")
def prefix_summary(spark, folder):
    """Rows per type and how many lie behind the requested first ten minutes."""
    return signals(spark, folder).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("t_ms") >= 600_000).alias("outside_prefix"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))
