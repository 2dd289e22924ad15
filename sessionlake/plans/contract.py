"""Contracts, quality rules and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionlake.functions.scalars import deterministic_id, frame_ms, half_even_ms, optional_int, truth
from sessionlake.operators import contracts as ops
from sessionlake.operators.ordering import time_order
from sessionlake.plans.clock import _LEDGER_SQL, hud_ledger
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import SESSION_DURATION_MS, SIGNAL_SQL, signals, table

_W = "PARTITION BY session_id ORDER BY t_ms, event_id"


@query("contract_violations", f"""
WITH {SIGNAL_SQL}, e AS (SELECT event_id, t_ms AS lo, t_ms + k - 3 AS hi, t_ms + k // 2 - CASE WHEN event_id % 19 = 0 THEN 5 ELSE 0 END AS an,
  k - 2.0 AS q, 1.0 AS qmin, k / 10.0 AS qmax FROM sig),
v AS (SELECT event_id, concat_ws('|', CASE WHEN hi < lo THEN 'bounds_out_of_order' END, CASE WHEN an < lo OR an > hi THEN 'anchor_outside_bounds' END,
  CASE WHEN q < 0 OR qmin < 0 OR qmax < 0 THEN 'negative_quantity' END, CASE WHEN qmax < qmin THEN 'quantity_bounds_out_of_order' END) AS violations FROM e)
SELECT * FROM v WHERE violations <> ''""")
def contract_violations(spark, folder):
    t, k = F.col("t_ms"), F.col("k")
    rows = signals(spark, folder).select(
        "event_id", t.alias("time_lower_ms"), (t + k - 3).alias("time_upper_ms"),
        (t + F.expr("k div 2") - F.when(F.col("event_id") % 19 == 0, 5).otherwise(0)).alias("anchor_time_ms"), (k - 2.0).alias("quantity"),
        F.lit(1.0).alias("quantity_min"), (k / 10.0).alias("quantity_max"))
    return ops.event_violations(rows).select("event_id", "violations")


@query("observation_violations", f"""
WITH {SIGNAL_SQL}, o AS (SELECT event_id, k - 1 AS frame_number, t_ms - 500 AS media_time_ms FROM sig),
v AS (SELECT event_id, concat_ws('|', CASE WHEN frame_number < 0 THEN 'negative_frame' END, CASE WHEN media_time_ms < 0 THEN 'negative_time' END) AS violations FROM o)
SELECT * FROM v WHERE violations <> ''""")
def observation_violations(spark, folder):
    rows = signals(spark, folder).select("event_id", (F.col("k") - 1).alias("frame"), (F.col("t_ms") - 500).alias("time"))
    return rows.select("event_id", ops.listed(negative_frame=F.col("frame") < 0, negative_time=F.col("time") < 0).alias("violations")).filter("violations <> ''")


@query("catalogue_violations", """
WITH c AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE 'code_' || (p_partkey % 600) END AS code,
  CASE p_partkey % 6 WHEN 0 THEN 'point' WHEN 1 THEN 'interval' WHEN 2 THEN 'state' WHEN 3 THEN 'counter' WHEN 4 THEN 'point' ELSE 'other' END AS temporal_type,
  CASE WHEN p_partkey % 7 = 0 THEN 'draft' ELSE 'production' END AS maturity FROM part),
n AS (SELECT code, count(*) AS n FROM c GROUP BY ALL),
v AS (SELECT DISTINCT code, concat_ws('|', CASE WHEN trim(code) = '' THEN 'empty_code' END, CASE WHEN n > 1 THEN 'duplicate_code' END,
  CASE WHEN temporal_type NOT IN ('point', 'interval', 'state', 'counter') THEN 'unknown_temporal_type' END,
  CASE WHEN maturity NOT IN ('production', 'experimental') THEN 'unknown_maturity' END) AS violations FROM c JOIN n USING (code))
SELECT * FROM v WHERE violations <> ''""")
def catalogue_violations(spark, folder):
    p = F.col("p_partkey")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("point", "interval", "state", "counter", "point", "other")]), (p % 6 + 1).cast("int"))
    rows = table(spark, folder, "part").select(
        F.when(p % 50 == 0, " ").otherwise(F.concat(F.lit("code_"), (p % 600).cast("string"))).alias("code"), kinds.alias("temporal_type"),
        F.when(p % 7 == 0, "draft").otherwise("production").alias("maturity"))
    return ops.catalogue_violations(rows, ("point", "interval", "state", "counter"), ("production", "experimental"))


@query("ledger_violations", f"""
WITH {_LEDGER_SQL}, n AS (SELECT *, lag(second) OVER (PARTITION BY session_id ORDER BY second) AS ps,
  last_value(counter_state IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY second ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc FROM led),
v AS (SELECT session_id, second, counter_state, concat_ws('|', CASE WHEN second <> ps + 1 THEN 'second_not_contiguous' END,
  CASE WHEN counter_state < 0 THEN 'negative_counter' END, CASE WHEN counter_state < pc THEN 'counter_decreases' END) AS violations FROM n)
SELECT * FROM v WHERE violations <> ''""")
def ledger_violations(spark, folder):
    rows = hud_ledger(spark, folder).select("session_id", "second", "counter_state")
    return ops.ledger_violations(rows, time_order(rows, by=("second", "second")), second="second", counter="counter_state")


_PICKUP_SQL = """
pk AS (SELECT session_id, event_id, t_ms, CASE WHEN event_id % 31 = 0 THEN t_ms * 30 // 1000 ELSE CAST(round_even(t_ms * 30 / 1000, 0) AS BIGINT) END AS frame, k % 3 AS blue, (k + 1) % 2 AS green, CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS red,
  CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END AS unresolved, CASE WHEN event_id % 17 = 0 THEN NULL ELSE (k * 1.2) / 100 END AS confidence, k < 20 AS needs_review,
  CASE k % 5 WHEN 0 THEN 'visual_trajectory' WHEN 1 THEN 'visual_disappearance' WHEN 2 THEN 'percentage_assist' WHEN 3 THEN 'xp_single_step' ELSE 'none' END AS color_evidence,
  CASE WHEN k % 3 = 0 THEN 'Blue ' WHEN k % 3 = 1 THEN '' ELSE 'teal' END AS c1, CASE WHEN k % 2 = 0 THEN 'RED' ELSE NULL END AS c2, 'green' AS c3 FROM sig WHERE event_type <> 'error'),
pb AS (SELECT *, blue + green + red + unresolved + CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS total FROM pk)"""


def pickup_rows(spark, folder):
    k, e = F.col("k"), F.col("event_id")
    zero = lambda condition, value: F.when(condition, value).otherwise(0).cast("long")
    evidence = F.element_at(F.array(*[F.lit(x) for x in ("visual_trajectory", "visual_disappearance", "percentage_assist", "xp_single_step", "none")]), (k % 5 + 1).cast("int"))
    rows = signals(spark, folder).filter("event_type <> 'error'").select(
        "session_id", "event_id", "t_ms", F.when(e % 31 == 0, F.expr("t_ms * 30 div 1000")).otherwise(F.bround(F.col("t_ms") * 30 / 1000).cast("long")).alias("frame"),
        (k % 3).alias("blue"), ((k + 1) % 2).alias("green"), zero(k % 10 == 0, 1).alias("red"), zero(k % 4 == 0, 2).alias("unresolved"),
        F.when(e % 17 != 0, k * 1.2 / 100).alias("confidence"), (k < 20).alias("needs_review"), evidence.alias("color_evidence"),
        F.when(k % 3 == 0, "Blue ").when(k % 3 == 1, "").otherwise("teal").alias("c1"), F.when(k % 2 == 0, "RED").alias("c2"), F.lit("green").alias("c3"))
    return rows.withColumn("total", F.col("blue") + F.col("green") + F.col("red") + F.col("unresolved") + zero(e % 23 == 0, 1))


@query("pickup_violations", f"""
WITH {SIGNAL_SQL}, {_PICKUP_SQL}, n AS (SELECT *, lag(frame) OVER ({_W}) AS pf FROM pb),
v AS (SELECT session_id, event_id, concat_ws('|', CASE WHEN frame < pf THEN 'frame_out_of_order' END, CASE WHEN t_ms > {SESSION_DURATION_MS} - 5000 THEN 'outside_duration' END,
  CASE WHEN abs(round_even(frame / 30.0 * 1000, 0) - t_ms) > 2 THEN 'frame_time_mismatch' END, CASE WHEN blue + green + red + unresolved <> total THEN 'unbalanced_categories' END,
  CASE WHEN confidence IS NULL OR confidence NOT BETWEEN 0 AND 1 THEN 'invalid_confidence' END) AS violations FROM n)
SELECT * FROM v WHERE violations <> ''""")
def pickup_violations(spark, folder):
    rows = pickup_rows(spark, folder)
    return ops.pickup_violations(rows, time_order(rows), fps=30.0, duration_ms=SESSION_DURATION_MS - 5_000).select("session_id", "event_id", "violations")


@query("pickup_explode", f"""
WITH {SIGNAL_SQL}, {_PICKUP_SQL},
u AS (SELECT *, 'blue' AS kind, blue AS quantity FROM pb UNION ALL SELECT *, 'green', green FROM pb UNION ALL SELECT *, 'red', red FROM pb UNION ALL SELECT *, 'unresolved', unresolved FROM pb)
SELECT session_id, event_id || '_' || kind AS event_key, kind || '_gem_pickup' AS event_type, CAST(quantity AS BIGINT) AS quantity,
  CASE WHEN needs_review THEN 'C' ELSE 'B' END AS evidence_grade, CASE WHEN needs_review THEN 'needs_review' ELSE 'auto_accepted' END AS publication_status,
  CASE color_evidence WHEN 'visual_trajectory' THEN 'trajectory_heuristic' WHEN 'visual_disappearance' THEN 'visual_disappearance_heuristic'
    WHEN 'percentage_assist' THEN 'percentage_assist_calibration' WHEN 'xp_single_step' THEN 'xp_magnitude_fallback' ELSE 'ambiguous_heuristic' END AS confidence_method
FROM u WHERE quantity > 0""")
def pickup_explode(spark, folder):
    rows = pickup_rows(spark, folder)
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("long").alias("quantity")) for c in ops.COLOURS])).alias("g")
    d = rows.select("session_id", "event_id", "needs_review", "color_evidence", kinds).filter("g.quantity > 0")
    return d.select("session_id", F.concat_ws("_", F.col("event_id").cast("string"), "g.kind").alias("event_key"), F.concat("g.kind", F.lit("_gem_pickup")).alias("event_type"),
                    "g.quantity", F.when(F.col("needs_review"), "C").otherwise("B").alias("evidence_grade"),
                    F.when(F.col("needs_review"), "needs_review").otherwise("auto_accepted").alias("publication_status"),
                    ops.confidence_method(F.col("color_evidence")).alias("confidence_method"))


@query("pickup_projection", f"""
WITH {SIGNAL_SQL}, {_PICKUP_SQL},
c AS (SELECT *, CASE WHEN lower(trim(c1)) IN ('blue', 'green', 'red') THEN lower(trim(c1)) WHEN lower(trim(c2)) IN ('blue', 'green', 'red') THEN lower(trim(c2)) ELSE c3 END AS cand FROM pb)
SELECT session_id, event_id, CAST(blue + green + red + unresolved AS BIGINT) AS total_quantity,
  concat_ws('|', CASE WHEN blue > 0 THEN 'blue' END, CASE WHEN green > 0 THEN 'green' END, CASE WHEN red > 0 THEN 'red' END, CASE WHEN unresolved > 0 THEN 'unresolved' END) AS types_with_confidence,
  CASE WHEN unresolved > 0 THEN cand END AS closest_candidate, CASE WHEN unresolved > 0 THEN CAST(coalesce(confidence, 0) AS DOUBLE) END AS closest_confidence,
  CASE WHEN unresolved > 0 THEN CASE WHEN coalesce(confidence, 0) >= 0.25 THEN CAST(unresolved AS BIGINT) ELSE 0 END END AS closest_quantity,
  CASE WHEN unresolved > 0 THEN coalesce(confidence, 0) >= 0.25 END AS closest_assigned
FROM c WHERE blue + green + red + unresolved > 0""")
def pickup_projection(spark, folder):
    rows = pickup_rows(spark, folder)
    total = F.col("blue") + F.col("green") + F.col("red") + F.col("unresolved")
    quantities = F.create_map(*[part for c in ops.COLOURS for part in (F.lit(c), F.col(c))])
    confidence = F.coalesce("confidence", F.lit(0.0))
    positive = F.map_filter(quantities, lambda _, q: q > 0)
    closest = F.when(F.col("unresolved") > 0, ops.closest_colour([F.col("c1"), F.col("c2"), F.col("c3")], F.col("unresolved"), confidence))
    d = rows.filter(total > 0).select("session_id", "event_id", total.alias("total_quantity"), F.array_join(F.map_keys(positive), "|").alias("types_with_confidence"), closest.alias("c"))
    return d.select("session_id", "event_id", "total_quantity", "types_with_confidence", F.col("c.candidate").alias("closest_candidate"),
                    F.col("c.confidence").alias("closest_confidence"), F.col("c.quantity").alias("closest_quantity"), F.col("c.assigned").alias("closest_assigned"))


@query("pickup_summary", f"""
WITH {SIGNAL_SQL}, {_PICKUP_SQL}
SELECT session_id, count(*) AS source_rows, CAST(sum(blue) AS BIGINT) AS blue, CAST(sum(green) AS BIGINT) AS green, CAST(sum(red) AS BIGINT) AS red, CAST(sum(unresolved) AS BIGINT) AS unresolved,
  count(*) FILTER (needs_review) AS review_events, round(count(*) FILTER (needs_review) / count(*), 6) AS review_fraction,
  CASE WHEN sum(blue + green + red + unresolved) > 0 THEN round(sum(unresolved) / sum(blue + green + red + unresolved), 6) END AS unresolved_fraction FROM pb GROUP BY session_id""")
def pickup_summary(spark, folder):
    """Totals per session; without a single pickup the unresolved share is undefined, not zero."""
    total = F.sum(F.col("blue") + F.col("green") + F.col("red") + F.col("unresolved"))
    return pickup_rows(spark, folder).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("source_rows"), *[F.sum(c).alias(c) for c in ops.COLOURS], F.count_if("needs_review").alias("review_events"),
        F.round(F.count_if("needs_review") / F.count(F.lit(1)), 6).alias("review_fraction"),
        F.when(total > 0, F.round(F.sum("unresolved") / total, 6)).alias("unresolved_fraction"))


@query("deterministic_ids", f"""
WITH {SIGNAL_SQL}
SELECT event_id, 'obs_' || substr(sha256('run_1' || chr(31) || session_id || chr(31) || 'hud_second:' || (t_ms // 1000) || ':kill_counter'), 1, 24) AS observation_id FROM sig""")
def deterministic_ids(spark, folder):
    key = F.concat(F.lit("hud_second:"), F.expr("string(t_ms div 1000)"), F.lit(":kill_counter"))
    return signals(spark, folder).select("event_id", deterministic_id("obs", F.lit("run_1"), F.col("session_id"), key).alias("observation_id"))


@query("text_values", f"""
WITH {SIGNAL_SQL}, t AS (SELECT event_id, t_ms, k, CASE event_id % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'TRUE' WHEN 2 THEN '0' WHEN 3 THEN '' WHEN 4 THEN 'no' ELSE '1' END AS flag,
  CASE event_id % 5 WHEN 0 THEN ' NaN' WHEN 1 THEN 'none' WHEN 2 THEN k || '.7' WHEN 3 THEN '' ELSE '-' || k || '.5' END AS num FROM sig)
SELECT event_id, lower(trim(flag)) IN ('1', 'true', 'yes') AS flag,
  CASE WHEN lower(trim(num)) IN ('', 'none', 'null', 'nan') THEN NULL ELSE CAST(trunc(CAST(num AS DOUBLE)) AS BIGINT) END AS num,
  CAST(round_even((k + 0.5) / 1000 * 1000, 0) AS BIGINT) AS ms_half_even, CAST(round_even(k / 30.0 * 1000, 0) AS BIGINT) AS frame_ms FROM t""")
def text_values(spark, folder):
    pick = lambda divisor, *options: F.element_at(F.array(*[o if not isinstance(o, str) else F.lit(o) for o in options]), (F.col("event_id") % divisor + 1).cast("int"))
    flag = pick(6, " Yes ", "TRUE", "0", "", "no", "1")
    k = F.col("k").cast("string")
    num = pick(5, " NaN", "none", F.concat(k, F.lit(".7")), "", F.concat(F.lit("-"), k, F.lit(".5")))
    return signals(spark, folder).select("event_id", truth(flag).alias("flag"), optional_int(num).alias("num"),
                                         half_even_ms((F.col("k") + 0.5) / 1000).alias("ms_half_even"), frame_ms(F.col("k"), 30.0).alias("frame_ms"))


@query("quality_case", f"""
WITH {SIGNAL_SQL}, q AS (SELECT event_id, CASE k % 3 WHEN 0 THEN 'kill_counter' WHEN 1 THEN 'game_clock' ELSE 'gem_pickup' END AS code, event_type = 'error' AS ex, k % 5 > 1 AS vo,
  CASE WHEN k % 7 = 0 THEN NULL ELSE k % 4 > 0 END AS oo, k < 30 AS nr, k % 2 = 0 AS vis, k % 5 > 0 AS bar FROM sig)
SELECT event_id, CASE WHEN ex THEN FALSE WHEN code = 'kill_counter' THEN vo WHEN code = 'game_clock' THEN coalesce(oo, TRUE) ELSE TRUE END AS observed,
  CASE WHEN ex THEN 'unknown' WHEN code = 'kill_counter' THEN CASE WHEN vo THEN 'visible' ELSE 'unknown' END WHEN code = 'game_clock' THEN CASE WHEN coalesce(oo, TRUE) THEN 'visible' ELSE 'partial' END
    ELSE CASE WHEN vis THEN 'visible' ELSE 'partial' END END AS visibility,
  CASE WHEN ex THEN 'unresolved' WHEN code = 'kill_counter' THEN CASE WHEN vo THEN 'A' ELSE 'C' END WHEN code = 'game_clock' THEN CASE WHEN coalesce(oo, TRUE) THEN 'A' ELSE 'B' END
    WHEN nr THEN 'C' WHEN vis AND bar THEN 'A' ELSE 'B' END AS grade FROM q""")
def quality_case(spark, folder):
    k = F.col("k")
    code = F.element_at(F.array(F.lit("kill_counter"), F.lit("game_clock"), F.lit("gem_pickup")), (k % 3 + 1).cast("int"))
    modalities = F.array_compact(F.array(F.when(k % 2 == 0, "visual"), F.when(k % 5 > 0, "experience_bar_change")))
    quality = ops.signal_quality(code, F.col("event_type") == "error", k % 5 > 1, F.when(k % 7 != 0, k % 4 > 0), k < 30, modalities)
    return signals(spark, folder).select("event_id", quality.alias("q")).select("event_id", "q.*")


@query("signal_scan", f"""
WITH {SIGNAL_SQL}, s AS (SELECT event_id, session_id, t_ms AS lower_ms, t_ms + k * 10 AS upper_ms, event_type, CASE WHEN event_id % 9 = 0 THEN 'manual' ELSE 'automated' END AS source_type FROM sig)
SELECT event_id, session_id, event_type, lower_ms, upper_ms FROM s WHERE event_type IN ('click', 'view', 'purchase') AND source_type = 'automated' AND upper_ms > 120000 AND lower_ms < 480000""")
def signal_scan(spark, folder):
    """Supported automated signals that overlap a half-open range."""
    rows = signals(spark, folder).select("event_id", "session_id", "event_type", F.col("t_ms").alias("lower_ms"), (F.col("t_ms") + F.col("k") * 10).alias("upper_ms"),
                                         F.when(F.col("event_id") % 9 == 0, "manual").otherwise("automated").alias("source_type"))
    return rows.filter("event_type IN ('click', 'view', 'purchase') AND source_type = 'automated' AND upper_ms > 120000 AND lower_ms < 480000").drop("source_type")


@query("scan_summary", f"""
WITH {SIGNAL_SQL}
SELECT 'state' AS facet, event_type AS value, count(*) AS n FROM sig GROUP BY event_type
UNION ALL SELECT 'visibility', CASE WHEN k < 10 THEN 'unknown' WHEN k < 40 THEN 'partial' ELSE 'visible' END, count(*) FROM sig GROUP BY 2
UNION ALL SELECT 'code', CASE k % 3 WHEN 0 THEN 'kill_counter' WHEN 1 THEN 'game_clock' ELSE 'gem_pickup' END, count(*) FROM sig GROUP BY 2""")
def scan_summary(spark, folder):
    k = F.col("k")
    facets = F.explode(F.array(
        F.struct(F.lit("state").alias("facet"), F.col("event_type").alias("value")),
        F.struct(F.lit("visibility").alias("facet"), F.when(k < 10, "unknown").when(k < 40, "partial").otherwise("visible").alias("value")),
        F.struct(F.lit("code").alias("facet"), F.when(k % 3 == 0, "kill_counter").when(k % 3 == 1, "game_clock").otherwise("gem_pickup").alias("value")))).alias("f")
    return signals(spark, folder).select(facets).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


_INV_SQL = """
iv AS (SELECT session_id, event_id, t_ms, CASE WHEN event_id % 13 = 0 THEN 'initial_state' WHEN k % 10 = 0 THEN 'evolution' WHEN k % 3 = 0 THEN 'New' ELSE 'upgrade ' END AS change,
  CASE WHEN k % 2 = 0 THEN 'weapon' WHEN k % 7 = 1 THEN 'relic' ELSE 'passive_item' END AS item_type, 'item_' || (k % 12) AS item_after, CASE WHEN k % 4 = 0 THEN '' ELSE 'item_' || (k % 11) END AS item_before,
  CASE WHEN k % 5 = 0 THEN 'treasure_chest' ELSE 'level_up' END AS event_source, CASE WHEN k < 25 THEN '1' ELSE 'False' END AS needs_review,
  CASE WHEN k % 3 = 0 THEN 'HIGH' ELSE 'medium' END AS confidence, CASE WHEN k % 6 = 0 THEN '' ELSE CAST(k % 9 AS VARCHAR) END AS level_after, k % 30 AS character_level FROM sig WHERE event_type IN ('click', 'purchase'))"""


def inventory_rows(spark, folder):
    k, e = F.col("k"), F.col("event_id")
    item = lambda n: F.concat(F.lit("item_"), (k % n).cast("string"))
    return signals(spark, folder).filter("event_type IN ('click', 'purchase')").select(
        "session_id", "event_id", "t_ms", F.when(e % 13 == 0, "initial_state").when(k % 10 == 0, "evolution").when(k % 3 == 0, "New").otherwise("upgrade ").alias("change"),
        F.when(k % 2 == 0, "weapon").when(k % 7 == 1, "relic").otherwise("passive_item").alias("item_type"), item(12).alias("item_after"),
        F.when(k % 4 == 0, "").otherwise(item(11)).alias("item_before"), F.when(k % 5 == 0, "treasure_chest").otherwise("level_up").alias("event_source"),
        F.when(k < 25, "1").otherwise("False").alias("needs_review"), F.when(k % 3 == 0, "HIGH").otherwise("medium").alias("confidence"),
        F.when(k % 6 == 0, "").otherwise((k % 9).cast("string")).alias("level_after"), (k % 30).alias("character_level"))


@query("inventory_adapter", f"""
WITH {SIGNAL_SQL}, {_INV_SQL}, g AS (SELECT *, lower(trim(needs_review)) IN ('1', 'true', 'yes', 'y') AS nr, lower(confidence) = 'high' AS hi, lower(trim(change)) AS ch FROM iv WHERE change <> 'initial_state'),
b AS (SELECT *, CASE WHEN nr THEN 'C' WHEN hi THEN 'A' ELSE 'B' END AS evidence_grade, CASE WHEN nr THEN 'needs_review' ELSE 'auto_accepted' END AS publication_status FROM g)
SELECT session_id, 'evt_' || event_id || '_selection' AS event_id, 'level_up_selection' AS event_type, 'progression' AS event_family, t_ms AS anchor_time_ms, evidence_grade, publication_status,
  CAST(NULL AS VARCHAR) AS selection_event_id, CAST(NULL AS VARCHAR) AS item_name FROM b WHERE event_source LIKE 'level_up%'
UNION ALL SELECT session_id, 'evt_' || event_id || '_outcome', CASE WHEN ch = 'evolution' THEN 'weapon_evolution' WHEN ch = 'new' AND item_type = 'weapon' THEN 'new_weapon' WHEN ch = 'new' AND item_type = 'passive_item' THEN 'new_passive_item'
  WHEN ch = 'upgrade' AND item_type = 'weapon' THEN 'weapon_upgrade' WHEN ch = 'upgrade' AND item_type = 'passive_item' THEN 'passive_item_upgrade' ELSE 'inventory_change' END, 'inventory', t_ms, evidence_grade, publication_status,
  CASE WHEN event_source LIKE 'level_up%' THEN 'evt_' || event_id || '_selection' END, item_after FROM b""")
def inventory_adapter(spark, folder):
    """A level-up change becomes a selection and an outcome linked by id; other changes are outcomes only."""
    rows = inventory_rows(spark, folder).filter("change <> 'initial_state'")
    review = truth(F.col("needs_review"), ("1", "true", "yes", "y"))
    grade = F.when(review, "C").when(F.lower("confidence") == "high", "A").otherwise("B")
    status = F.when(review, "needs_review").otherwise("auto_accepted")
    base = F.concat(F.lit("evt_"), F.col("event_id").cast("string"))
    selection_id = F.concat(base, F.lit("_selection"))
    from_menu = F.col("event_source").startswith("level_up")
    none = F.lit(None).cast("string")
    event = lambda ident, kind, family, link, item: F.struct(ident.alias("event_id"), kind.alias("event_type"), F.lit(family).alias("event_family"), link.alias("selection_event_id"), item.alias("item_name"))
    selection = event(selection_id, F.lit("level_up_selection"), "progression", none, none)
    outcome = event(F.concat(base, F.lit("_outcome")), ops.inventory_event_type(F.col("change"), F.col("item_type")), "inventory", F.when(from_menu, selection_id), F.col("item_after"))
    made = F.explode(F.when(from_menu, F.array(selection, outcome)).otherwise(F.array(outcome))).alias("e")
    return rows.select("session_id", F.col("t_ms").alias("anchor_time_ms"), grade.alias("evidence_grade"), status.alias("publication_status"), made).select(
        "session_id", "anchor_time_ms", "evidence_grade", "publication_status", "e.*")


@query("event_set_duplicates", f"""
WITH {SIGNAL_SQL}, u AS (SELECT 'evt_' || (event_id % 5000) AS event_id, t_ms FROM sig WHERE event_type = 'click' UNION ALL SELECT 'evt_' || (event_id % 7000), t_ms FROM sig WHERE event_type = 'view')
SELECT event_id, count(*) AS copies, min(t_ms) AS first_ms FROM u GROUP BY ALL HAVING count(*) > 1""")
def event_set_duplicates(spark, folder):
    """Identifiers that several sources would publish."""
    rows = signals(spark, folder)
    named = lambda kind, modulus: rows.filter(F.col("event_type") == kind).select(F.concat(F.lit("evt_"), (F.col("event_id") % modulus).cast("string")).alias("event_id"), "t_ms")
    both = named("click", 5_000).unionByName(named("view", 7_000))
    return both.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"), F.min("t_ms").alias("first_ms")).filter("copies > 1")


@query("inventory_projection", f"""
WITH {SIGNAL_SQL}, {_INV_SQL}
SELECT event_id, t_ms + 1000 AS media_time_ms, character_level AS observed_character_level, CASE WHEN change = 'New' THEN 'new' ELSE 'upgrade' END AS action, item_after AS item_name, nullif(item_before, '') AS item_before,
  CASE WHEN coalesce(TRY_CAST(level_after AS BIGINT), 0) = 0 THEN 1 ELSE CAST(level_after AS BIGINT) END AS item_level_after, needs_review = '1' AS needs_review FROM iv WHERE change <> 'initial_state'""")
def inventory_projection(spark, folder):
    level = optional_int(F.col("level_after"))
    return inventory_rows(spark, folder).filter("change <> 'initial_state'").select(
        "event_id", (F.col("t_ms") + 1_000).alias("media_time_ms"), F.col("character_level").alias("observed_character_level"),
        F.when(F.lower("change") == "new", "new").otherwise("upgrade").alias("action"), F.col("item_after").alias("item_name"),
        F.nullif(F.col("item_before"), F.lit("")).alias("item_before"), F.when(F.coalesce(level, F.lit(0)) == 0, 1).otherwise(level).cast("long").alias("item_level_after"),
        truth(F.col("needs_review")).alias("needs_review"))


@query("selection_projection", f"""
WITH {SIGNAL_SQL}, {_INV_SQL}, g AS (SELECT *, CASE WHEN lower(confidence) = 'high' AND needs_review <> '1' THEN 'B' ELSE 'C' END AS evidence_grade FROM iv WHERE change <> 'initial_state')
SELECT event_id || '_transaction' AS event_id, 'level_up_transaction' AS event_type, 'progression' AS family, t_ms AS anchor_ms, evidence_grade FROM g
UNION ALL SELECT CAST(event_id AS VARCHAR), 'level_up_selection', 'inventory', t_ms, evidence_grade FROM g""")
def selection_projection(spark, folder):
    rows = inventory_rows(spark, folder).filter("change <> 'initial_state'")
    grade = F.when((F.lower("confidence") == "high") & ~truth(F.col("needs_review")), "B").otherwise("C")
    ident = F.col("event_id").cast("string")
    kinds = F.explode(F.array(
        F.struct(F.concat(ident, F.lit("_transaction")).alias("event_id"), F.lit("level_up_transaction").alias("event_type"), F.lit("progression").alias("family")),
        F.struct(ident.alias("event_id"), F.lit("level_up_selection").alias("event_type"), F.lit("inventory").alias("family")))).alias("e")
    return rows.select(kinds, F.col("t_ms").alias("anchor_ms"), grade.alias("evidence_grade")).select("e.*", "anchor_ms", "evidence_grade")


@query("bar_acceptance", f"""
WITH {SIGNAL_SQL}, f AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE k / 100.0 END AS p, 0.6 + (event_id % 40) / 100.0 AS q, 0.8 + (event_id % 17) / 80.0 AS h, (k % 40) / 100.0 AS o, event_type = 'error' AS b FROM sig),
g AS (SELECT *, p IS NOT NULL AND q >= 0.78 AS clear, p IS NOT NULL AND q >= 0.78 AND NOT b AND h >= 0.9 AND o < 0.3 AS ok FROM f)
SELECT event_id, CASE WHEN ok THEN CAST(p AS DOUBLE) END AS value, CASE WHEN ok THEN 'visible' WHEN b OR o >= 0.3 OR clear THEN 'occluded' ELSE 'unknown' END AS visibility,
  CASE WHEN ok THEN 'A' WHEN b OR o >= 0.3 OR clear THEN 'C' ELSE 'unresolved' END AS grade,
  CASE WHEN ok THEN 'quality_and_gameplay_hud_passed' WHEN b THEN 'gameplay_paused' WHEN o >= 0.3 THEN 'level_up_overlay_present' WHEN clear THEN 'gameplay_hud_not_confirmed' ELSE 'xp_bar_quality_below_threshold' END AS reason FROM g""")
def bar_acceptance(spark, folder):
    e, k = F.col("event_id"), F.col("k")
    # the features carry two to four decimals, as a detector would write them
    r = lambda x: F.round(x, 6)
    gate = ops.bar_acceptance(F.when(e % 11 != 0, k / 100.0), r(0.6 + e % 40 / 100.0), r(0.8 + e % 17 / 80.0), r(k % 40 / 100.0), F.col("event_type") == "error")
    return signals(spark, folder).select("event_id", gate.alias("g")).select("event_id", "g.*")


@query("screen_states", f"""
WITH {SIGNAL_SQL}, f AS (SELECT event_id, (event_id % 60) / 100.0 AS p, (k % 50) / 100.0 AS r, (k % 30) / 100.0 AS l FROM sig)
SELECT event_id, CASE WHEN p > 0.45 AND r > 0.08 THEN 'results' WHEN r > 0.30 AND p > 0.05 AND p < 0.30 AND l < 0.22 THEN 'pregame_menu' WHEN l > 0.23 AND p < 0.32 THEN 'game_over' ELSE 'gameplay_or_overlay' END AS state FROM f""")
def screen_states(spark, folder):
    state = ops.screen_state(F.col("event_id") % 60 / 100.0, F.col("k") % 50 / 100.0, F.col("k") % 30 / 100.0)
    return signals(spark, folder).select("event_id", state.alias("state"))


@query("slot_matches", """
WITH s AS (SELECT DISTINCT l_orderkey AS sample, 'weapon_' || l_linenumber AS name, round(l_discount * 4 + l_tax * 5, 2) AS score FROM lineitem),
r AS (SELECT sample, name, score, row_number() OVER w AS rn, lead(name) OVER w AS n2, lead(score) OVER w AS s2 FROM s WINDOW w AS (PARTITION BY sample ORDER BY score DESC, name DESC)),
m AS (SELECT sample, name, score, coalesce(n2, '') AS runner_up, round(score - coalesce(s2, -1.0), 6) AS margin FROM r WHERE rn = 1)
SELECT sample, CASE WHEN score >= 0.25 THEN name ELSE 'UNKNOWN' END AS match, name AS suggested, score, runner_up, margin,
  CASE WHEN score >= 0.55 AND margin >= 0.08 THEN 'high' WHEN score >= 0.40 AND margin >= 0.04 THEN 'medium' ELSE 'low' END AS confidence,
  NOT ((score >= 0.55 AND margin >= 0.08) OR (score >= 0.40 AND margin >= 0.04)) AS needs_review FROM m""")
def slot_matches(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("sample"), F.concat(F.lit("weapon_"), F.col("l_linenumber").cast("string")).alias("name"),
        F.round(F.col("l_discount") * 4 + F.col("l_tax") * 5, 2).alias("score")).distinct()
    d = ops.best_matches(rows, ["sample"], "name", "score", unknown_below=0.25, high=(0.55, 0.08), medium=(0.40, 0.04))
    margin = F.round("margin", 6)
    label = ops.match_label(F.col("score"), margin, high=(0.55, 0.08), medium=(0.40, 0.04))
    return d.withColumns({"confidence": label, "needs_review": label == "low", "margin": margin})


@query("selection_exclusions", f"""
WITH {SIGNAL_SQL}, s AS (SELECT event_id, k % 60 AS cursor_score, k % 3 > 0 AS owned, k % 9 AS level, CASE WHEN k % 5 = 0 THEN NULL ELSE 8 - k % 4 END AS mx, event_id % 8 AS n, k % 2 = 0 AS nr FROM sig)
SELECT event_id, CASE WHEN cursor_score < 20 THEN 'selection_pointer_unconfirmed' WHEN owned AND mx IS NOT NULL AND level >= mx THEN 'item_already_at_normal_max'
  WHEN NOT owned AND n >= 6 AND nr THEN 'low_confidence_beyond_standard_slots' END AS reason FROM s""")
def selection_exclusions(spark, folder):
    k = F.col("k")
    reason = ops.selection_exclusion(k % 60, k % 3 > 0, k % 9, F.when(k % 5 != 0, 8 - k % 4), F.col("event_id") % 8, k % 2 == 0)
    return signals(spark, folder).select("event_id", reason.alias("reason"))


@query("slot_range_flags", """
SELECT l_orderkey, l_linenumber, CASE WHEN s BETWEEN 1 AND 6 THEN CAST(s AS VARCHAR) ELSE 'unresolved' END AS slot, NOT coalesce(s BETWEEN 1 AND 6, FALSE) OR l_returnflag = 'R' AS needs_review
FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 9 END AS s FROM lineitem)""")
def slot_range_flags(spark, folder):
    slot = F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("long") % 9)
    fits = F.coalesce(slot.between(1, 6), F.lit(False))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.when(fits, slot.cast("string")).otherwise("unresolved").alias("slot"),
                                                   (~fits | (F.col("l_returnflag") == "R")).alias("needs_review"))


@query("lucky_level_ups", f"""
WITH {SIGNAL_SQL} SELECT 'evt_lucky_level_up_' || t_ms AS event_id, session_id, t_ms - k * 10 AS time_lower_ms, t_ms AS anchor_time_ms, 'A' AS evidence_grade, 2 + k % 4 AS option_count FROM sig WHERE event_type = 'signup' AND 2 + k % 4 >= 4""")
def lucky_level_ups(spark, folder):
    rows = signals(spark, folder).filter("event_type = 'signup'").withColumn("option_count", 2 + F.col("k") % 4)
    return rows.filter("option_count >= 4").select(F.concat(F.lit("evt_lucky_level_up_"), F.col("t_ms").cast("string")).alias("event_id"), "session_id",
                                                   (F.col("t_ms") - F.col("k") * 10).alias("time_lower_ms"), F.col("t_ms").alias("anchor_time_ms"), F.lit("A").alias("evidence_grade"), "option_count")


@query("review_queue", f"""
WITH {SIGNAL_SQL} SELECT event_id, session_id, t_ms // 33 AS frame, greatest(0, t_ms // 33 - 7) AS first_frame, t_ms // 33 + 7 AS last_frame, '' AS coded_type, '' AS coded_count FROM sig""")
def review_queue(spark, folder):
    frame = F.expr("t_ms div 33")
    return signals(spark, folder).select("event_id", "session_id", frame.alias("frame"), F.greatest(F.lit(0), frame - 7).alias("first_frame"),
                                                          (frame + 7).alias("last_frame"), F.lit("").alias("coded_type"), F.lit("").alias("coded_count"))


@query("slot_occupancy", """
WITH a AS (SELECT l_orderkey, l_linenumber AS slot, l_discount >= 0.08 OR l_tax >= 0.07 OR l_quantity >= 45 AS active FROM lineitem),
m AS (SELECT l_orderkey, max(CASE WHEN active THEN slot ELSE 0 END) AS top FROM a GROUP BY ALL)
SELECT DISTINCT l_orderkey, slot, slot <= top AS occupied FROM a JOIN m USING (l_orderkey)""")
def slot_occupancy(spark, folder):
    """Slots fill from the left: every slot up to the last active one counts."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("slot"), ((F.col("l_discount") >= 0.08) | (F.col("l_tax") >= 0.07) | (F.col("l_quantity") >= 45)).alias("active"))
    # one row per slot before anything is sorted; the last active one stands on its order's rows instead of in a second table
    slots = rows.filter("l_orderkey IS NOT NULL").groupBy("l_orderkey", "slot").agg(F.max(F.when(F.col("active"), F.col("slot")).otherwise(0)).alias("top"))
    top = F.max("top").over(Window.partitionBy("l_orderkey"))
    return slots.select("l_orderkey", "slot", (F.col("slot") <= top).alias("occupied"))


@query("entry_rows", f"""
WITH {SIGNAL_SQL} SELECT event_id AS track_id, t_ms // 33 AS entry_frame, round(t_ms // 33 / 30.0, 4) AS entry_video_time, t_ms // 33 + 5 + k AS predicted_arrival_frame, round(value, 2) AS entry_distance,
 printf('%d:%06.3f', t_ms // 33 // 1800, t_ms // 33 / 30.0 - 60 * (t_ms // 33 // 1800)) AS stamp FROM sig WHERE event_type = 'click'""")
def entry_rows(spark, folder):
    frame = F.expr("t_ms div 33")
    seconds = frame / 30.0
    minutes = F.floor(seconds / 60)
    return signals(spark, folder).filter("event_type = 'click'").select(
        F.col("event_id").alias("track_id"), frame.alias("entry_frame"), F.round(seconds, 4).alias("entry_video_time"), (frame + 5 + F.col("k")).alias("predicted_arrival_frame"),
        F.round("value", 2).alias("entry_distance"), F.format_string("%d:%06.3f", minutes, seconds - minutes * 60).alias("stamp"))


@query("clock_observations", f"""
WITH {_LEDGER_SQL}
SELECT session_id, second, 'kill_counter' AS observable_code, second * 10000 AS media_start_ms, counter_state AS numeric_value, counter_observed AND NOT excluded AS observed, NOT excluded AND state_source <> 'observed' AS needs_review FROM led
UNION ALL SELECT session_id, second, 'game_clock', second * 10000, CASE WHEN NOT excluded THEN second * 10000 END, timer_observed AND NOT excluded, FALSE FROM led WHERE timer_observed OR excluded""")
def clock_observations(spark, folder):
    """Each ledger second yields a counter observation, and a clock observation when the clock is usable."""
    rows = hud_ledger(spark, folder)
    start = F.col("second") * 10_000
    obs = lambda code, value, observed, review: F.struct(F.lit(code).alias("observable_code"), value.alias("numeric_value"), observed.alias("observed"), review.alias("needs_review"))
    counter = obs("kill_counter", F.col("counter_state"), F.col("counter_observed") & ~F.col("excluded"), ~F.col("excluded") & (F.col("state_source") != "observed"))
    clock = obs("game_clock", F.when(~F.col("excluded"), start), F.col("timer_observed") & ~F.col("excluded"), F.lit(False))
    made = F.explode(F.when(F.col("timer_observed") | F.col("excluded"), F.array(counter, clock)).otherwise(F.array(counter))).alias("o")
    return rows.select("session_id", "second", start.alias("media_start_ms"), made).select("session_id", "second", "media_start_ms", "o.*")


@query("clock_issue_rows", f"""
WITH {_LEDGER_SQL} SELECT state_source AS status, count(*) AS n, count(*) FILTER (NOT timer_observed) AS unread FROM led GROUP BY ALL""")
def clock_issue_rows(spark, folder):
    return hud_ledger(spark, folder).groupBy(F.col("state_source").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("timer_observed")).alias("unread"))


_LADDER_SQL = """
ld AS (SELECT event_id, event_type = 'signup' AND k % 5 = 0 AS bd, k % 2 = 0 AS fl, CASE WHEN k % 3 = 0 THEN event_id % 3 ELSE 0 END AS tb, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS tg, 0 AS tr, CASE WHEN k % 5 = 1 THEN 1 ELSE 0 END AS db, CASE WHEN k % 5 = 2 THEN 2 ELSE 0 END AS dg,
  CASE WHEN k = 99 THEN 1 ELSE 0 END AS dr, (60 + k % 40) / 100.0 AS ts, (70 + event_id % 30) / 100.0 AS ds, k % 10 = 1 AS wa, CASE WHEN value < 30 THEN 'blue' WHEN value < 110 THEN 'green' WHEN value < 150 THEN 'red' ELSE 'unknown' END AS hint, k >= 95 AS sat, value / 30 AS ratio, event_id % 8 = 0 AS wt FROM sig),
l1 AS (SELECT *, NOT bd AND tb + tg + tr > 0 AS bt, NOT bd AND NOT (tb + tg + tr > 0) AND db + dg + dr > 0 AS bs FROM ld),
l2 AS (SELECT *, NOT bd AND NOT bt AND NOT bs AND NOT sat AND ratio <= 1.6 AS bp FROM l1), l3 AS (SELECT *, NOT bd AND NOT bt AND NOT bs AND NOT bp AS oc FROM l2),
l4 AS (SELECT *, CAST(CASE WHEN bt THEN greatest(tb, db) WHEN bs THEN db WHEN bp THEN 1 ELSE 0 END AS BIGINT) AS blue, CAST(CASE WHEN bt THEN greatest(tg, dg) WHEN bs THEN dg ELSE 0 END AS BIGINT) AS green, CAST(CASE WHEN bt THEN greatest(tr, dr) WHEN bs THEN dr ELSE 0 END AS BIGINT) AS red FROM l3),
l5 AS (SELECT *, blue + green + red AS n, (bt OR bs) AND hint <> 'unknown' AND NOT ((hint = 'blue' AND blue > 0) OR (hint = 'green' AND green > 0) OR (hint = 'red' AND red > 0)) AS cf, bs AND wa AS wk FROM l4),
l6 AS (SELECT *, CASE WHEN bt THEN least(0.98, 0.78 + 0.10 * ts + 0.03 * n) WHEN bs THEN least(0.98, 0.72 + 0.08 * n + 0.12 * ds) WHEN bp THEN 0.48 WHEN oc THEN 0.20 ELSE 0.0 END AS b0 FROM l5)"""


@query("pickup_composition", f"""
WITH {SIGNAL_SQL}, {_LADDER_SQL}
SELECT event_id, blue, green, red, CAST(CASE WHEN oc THEN 1 ELSE 0 END AS BIGINT) AS unresolved, CASE WHEN bd THEN 'level_up_boundary_pickup_count_unobserved' WHEN bt THEN 'visual_trajectory' WHEN wk THEN 'visual_disappearance_weak' WHEN bs THEN 'visual_disappearance'
  WHEN bp THEN 'xp_single_step_blue_fallback' ELSE 'xp_confirmed_color_ambiguous' END AS evidence, round(CAST(CASE WHEN wk THEN least(0.68, CASE WHEN cf THEN least(b0, 0.72) ELSE b0 END) WHEN cf THEN least(b0, 0.72) ELSE b0 END AS DOUBLE), 6) AS confidence,
  concat_ws('|', CASE WHEN bd THEN CASE WHEN fl THEN 'xp_bar_full_inferred_from_level_change' ELSE 'level_up_boundary_needs_visual_review' END END, CASE WHEN bt AND n > 1 THEN 'multiple_trajectory_pickups_in_one_xp_update' END, CASE WHEN wk THEN 'weak_visual_candidate_confirmed_by_single_xp_step' END,
    CASE WHEN bs AND n > 1 THEN 'multiple_sprites_disappeared_in_one_xp_update' END, CASE WHEN cf THEN 'visual_color_differs_from_merged_xp_value_band' END, CASE WHEN bp THEN 'blue_sized_xp_step_with_hidden_sprite' END,
    CASE WHEN oc THEN CASE WHEN sat THEN 'bar_saturated_and_no_disappearing_sprite' ELSE 'merged_or_high_value_xp_jump_without_direct_color' END END, CASE WHEN NOT bd AND wt THEN 'weak_template_match' END) AS reasons FROM l6""")
def pickup_composition(spark, folder):
    """Composition, confidence and review reasons of every experience update."""
    k, e, value = F.col("k"), F.col("event_id"), F.col("value")
    flag = lambda condition, n: F.when(condition, n).otherwise(0).cast("long")
    c = {"boundary": (F.col("event_type") == "signup") & (k % 5 == 0), "full_from_level": k % 2 == 0, "trajectories_blue": F.when(k % 3 == 0, e % 3).otherwise(0).cast("long"),
         "trajectories_green": flag(k % 7 == 0, 1), "trajectories_red": flag(F.lit(False), 1), "disappeared_blue": flag(k % 5 == 1, 1), "disappeared_green": flag(k % 5 == 2, 2),
         "disappeared_red": flag(k == 99, 1), "trajectory_score": (60 + k % 40) / 100.0, "disappeared_score": (70 + e % 30) / 100.0, "weak_accepted": k % 10 == 1,
         "hint": F.when(value < 30, "blue").when(value < 110, "green").when(value < 150, "red").otherwise("unknown"), "saturated": k >= 95, "step_ratio": value / 30, "weak_template": e % 8 == 0}
    d = signals(spark, folder).select("event_id", ops.pickup_composition(c).alias("p")).select("event_id", "p.*")
    return d.withColumn("confidence", F.round("confidence", 6))


@query("retrospective_outcomes", f"""
WITH {SIGNAL_SQL}, o AS (SELECT session_id, event_id, t_ms, CASE k % 3 WHEN 0 THEN 'Big Coin Bag' WHEN 1 THEN 'Floor Chicken' ELSE 'Little Heart' END AS outcome, k < 30 AS nr FROM sig WHERE event_type = 'signup')
SELECT session_id, 'evt_' || event_id || '_selection' AS event_id, 'level_up_selection' AS event_type, 'progression' AS event_family, t_ms AS anchor_time_ms, CASE WHEN nr THEN 'C' ELSE 'B' END AS evidence_grade, CAST(NULL AS VARCHAR) AS selection_event_id FROM o
UNION ALL SELECT session_id, 'evt_' || event_id || '_outcome', CASE outcome WHEN 'Big Coin Bag' THEN 'big_coin_bag' WHEN 'Floor Chicken' THEN 'floor_chicken' ELSE 'consumable_reward' END, CASE outcome WHEN 'Big Coin Bag' THEN 'currency' ELSE 'consumable' END, t_ms, CASE WHEN nr THEN 'C' ELSE 'B' END, 'evt_' || event_id || '_selection' FROM o""")
def retrospective_outcomes(spark, folder):
    """Reviewed reward menus: a selection and the outcome it led to."""
    k = F.col("k") % 3
    base = F.concat(F.lit("evt_"), F.col("event_id").cast("string"))
    selection_id = F.concat(base, F.lit("_selection"))
    kind = F.when(k == 0, "big_coin_bag").when(k == 1, "floor_chicken").otherwise("consumable_reward")
    made = F.explode(F.array(
        F.struct(selection_id.alias("event_id"), F.lit("level_up_selection").alias("event_type"), F.lit("progression").alias("event_family"), F.lit(None).cast("string").alias("selection_event_id")),
        F.struct(F.concat(base, F.lit("_outcome")).alias("event_id"), kind.alias("event_type"), F.when(k == 0, "currency").otherwise("consumable").alias("event_family"), selection_id.alias("selection_event_id")))).alias("e")
    return signals(spark, folder).filter("event_type = 'signup'").select(
        "session_id", F.col("t_ms").alias("anchor_time_ms"), F.when(F.col("k") < 30, "C").otherwise("B").alias("evidence_grade"), made).select("session_id", "anchor_time_ms", "evidence_grade", "e.*")


@query("canonical_projection", f"""
WITH {SIGNAL_SQL} SELECT event_id, event_type, t_ms AS start_ms, t_ms + k AS end_ms, CASE WHEN k % 4 = 0 THEN t_ms ELSE t_ms + k // 2 END AS anchor_ms, CASE WHEN event_type IN ('error', 'signup') THEN CAST(value AS DOUBLE) END AS previous_percent,
  CASE WHEN event_type IN ('error', 'signup') THEN 'health_bar' END AS modality FROM sig""")
def canonical_projection(spark, folder):
    """Published form of canonical events; the anchor falls back to the lower bound, and only health events keep their evidence."""
    health = F.col("event_type").isin("error", "signup")
    details = F.create_map(F.lit("previous_percent"), F.col("value").cast("string"))
    evidence = F.array(F.struct(F.lit("health.jsonl").alias("source_artifact"), F.col("event_id").cast("string").alias("source_record_key"), F.array(F.lit("health_bar")).alias("modalities"), details.alias("details")))
    rows = signals(spark, folder).select(
        "event_id", "event_type", F.col("t_ms").alias("time_lower_ms"), (F.col("t_ms") + F.col("k")).alias("time_upper_ms"),
        F.when(F.col("k") % 4 != 0, F.col("t_ms") + F.expr("k div 2")).alias("anchor_time_ms"), F.when(health, evidence).alias("evidence"))
    first = F.get("evidence", F.lit(0))
    return rows.select("event_id", "event_type", F.col("time_lower_ms").alias("start_ms"), F.col("time_upper_ms").alias("end_ms"), F.coalesce("anchor_time_ms", "time_lower_ms").alias("anchor_ms"),
                       first["details"]["previous_percent"].cast("double").alias("previous_percent"), F.get(first["modalities"], F.lit(0)).alias("modality"))


@query("fever_flags", f"""
WITH {SIGNAL_SQL}, f AS (SELECT event_id, k / 100.0 AS peak, (k + event_id % 5) / 120.0 AS sup, (event_id % 20) / 200.0 AS bot, 330 + k % 30 AS y, (event_id % 9) / 200.0 AS lab, event_type = 'error' AS paused, (80 + k % 20) / 100.0 AS hud FROM sig),
g AS (SELECT *, peak >= 0.60 AND sup >= 0.42 AND bot >= 0.06 AND y >= 344 AS gauge, lab >= 0.02 AS label FROM f)
SELECT event_id, gauge AS gauge_like, label AS label_like, gauge OR label AS visible_raw, (gauge OR label) AND NOT paused AND hud >= 0.90 AS fever_like FROM g""")
def fever_flags(spark, folder):
    """A gauge or label may stay visible behind a menu; only clear gameplay counts as active."""
    k, e = F.col("k"), F.col("event_id")
    gauge = (k / 100.0 >= 0.60) & ((k + e % 5) / 120.0 >= 0.42) & (e % 20 / 200.0 >= 0.06) & (330 + k % 30 >= 344)
    label = e % 9 / 200.0 >= 0.02
    seen = gauge | label
    return signals(spark, folder).select("event_id", gauge.alias("gauge_like"), label.alias("label_like"), seen.alias("visible_raw"),
                                         (seen & (F.col("event_type") != "error") & ((80 + k % 20) / 100.0 >= 0.90)).alias("fever_like"))


@query("likely_color_audit", f"""
WITH {SIGNAL_SQL} SELECT event_id, printf('%d:%02d', t_ms // 60000, t_ms // 1000 % 60) AS video_time_stamp, CASE WHEN k % 3 = 0 THEN 'blue' WHEN k % 3 = 1 THEN 'green' ELSE 'red' END AS likely_color, round(value, 2) AS gain, 'unresolved' AS quantity_status FROM sig WHERE event_type = 'view' AND k % 4 = 0""")
def likely_color_audit(spark, folder):
    """Audit rows of applied likely colours; they never imply a quantity."""
    k, t = F.col("k"), F.col("t_ms")
    return signals(spark, folder).filter("event_type = 'view' AND k % 4 = 0").select(
        "event_id", F.format_string("%d:%02d", F.expr("t_ms div 60000"), F.expr("t_ms div 1000 % 60")).alias("video_time_stamp"), F.when(k % 3 == 0, "blue").when(k % 3 == 1, "green").otherwise("red").alias("likely_color"),
        F.round("value", 2).alias("gain"), F.lit("unresolved").alias("quantity_status"))


@query("progress_points", f"""
WITH {SIGNAL_SQL}, x AS (SELECT session_id, event_id, t_ms, 1 + t_ms // 120000 AS level, round(CAST(k AS DOUBLE), 4) AS p, event_type = 'signup' AND k % 4 = 0 AS bound, (70 + k % 30) / 100.0 AS q FROM sig),
a AS (SELECT session_id, event_id, t_ms - 40 AS t_ms, level, p AS progress, CAST(NULL AS VARCHAR) AS anchor FROM x WHERE NOT bound AND q >= 0.85 UNION ALL SELECT session_id, event_id, t_ms, level, least(100.0, p + 1.5), NULL FROM x WHERE NOT bound AND q >= 0.85
  UNION ALL SELECT session_id, event_id, t_ms, level, 100.0, 'level_end' FROM x WHERE bound UNION ALL SELECT session_id, event_id, t_ms, level + 1, 0.0, 'level_start' FROM x WHERE bound)
SELECT * FROM a UNION ALL SELECT session_id, -1, 0, arg_min(level, (t_ms, event_id, level)), 0.0, 'level_start' FROM a GROUP BY session_id
  HAVING count(*) FILTER (progress = 0.0 AND level = (SELECT arg_min(b.level, (b.t_ms, b.event_id, b.level)) FROM a b WHERE b.session_id = a.session_id)) = 0""")
def progress_points(spark, folder):
    """Both ends of every measured increase, 100 and 0 at confirmed level borders, and the start of the first level."""
    k = F.col("k")
    x = signals(spark, folder).select("session_id", "event_id", "t_ms", F.expr("1 + t_ms div 120000").alias("level"), F.round(k.cast("double"), 4).alias("p"),
                                      ((F.col("event_type") == "signup") & (k % 4 == 0)).alias("bound"), ((70 + k % 30) / 100.0).alias("q"))
    none = F.lit(None).cast("string")
    point = lambda t, level, progress, anchor: F.struct(t.alias("t_ms"), level.alias("level"), progress.alias("progress"), anchor.alias("anchor"))
    t, level = F.col("t_ms"), F.col("level")
    border = F.array(point(t, level, F.lit(100.0), F.lit("level_end")), point(t, level + 1, F.lit(0.0), F.lit("level_start")))
    ends = F.array(point(t - 40, level, F.col("p"), none), point(t, level, F.least(F.lit(100.0), F.col("p") + 1.5), none))
    made = x.filter(F.col("bound") | (F.col("q") >= 0.85)).select("session_id", "event_id", F.explode(F.when(F.col("bound"), border).otherwise(ends)).alias("e"))
    points = made.select("session_id", "event_id", "e.*")
    # the first level of a session, and whether some point already shows its zero
    zeros = F.collect_set(F.when(F.col("progress") == 0.0, F.col("level")))
    first = points.groupBy("session_id").agg(F.min_by("level", F.struct("t_ms", "event_id", "level")).alias("level"), zeros.alias("zeros"))
    opening = first.filter(~F.array_contains("zeros", F.col("level"))).select(
        "session_id", F.lit(-1).cast("long").alias("event_id"), F.lit(0).cast("long").alias("t_ms"), "level", F.lit(0.0).alias("progress"), F.lit("level_start").alias("anchor"))
    return points.unionByName(opening)
