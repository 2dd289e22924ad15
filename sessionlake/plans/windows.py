"""Half-open windows, counter deltas, moving means and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.functions.scalars import clock_label
from sessionlake.operators import binning
from sessionlake.operators.ordering import time_order
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import COUNTER_SQL, SIGNAL_SQL, counters, signals

BIN_MS = 5_000

_SPINE_SQL = f"""
spine AS (
  SELECT session_id, b * {BIN_MS} AS start_ms, b * {BIN_MS} + {BIN_MS} AS end_ms
  FROM (SELECT session_id, unnest(range(n)) AS b FROM (SELECT session_id, max(t_ms) // {BIN_MS} + 1 AS n FROM sig GROUP BY session_id)))"""

_BOUNDARY_SQL = """
edges AS (
  SELECT sp.session_id, sp.start_ms, sp.end_ms, a.c AS c0, a.t_ms AS t0, z.c AS c1, z.t_ms AS t1
  FROM spine sp
  ASOF LEFT JOIN snap a ON sp.session_id = a.session_id AND sp.start_ms >= a.t_ms
  ASOF LEFT JOIN snap z ON sp.session_id = z.session_id AND sp.end_ms >= z.t_ms),
bw AS (
  SELECT session_id, start_ms, end_ms, coalesce(c0, 0) AS counter_start,
         CASE WHEN c0 IS NULL THEN 0 ELSE c1 END AS counter_end,
         CASE WHEN c0 IS NOT NULL AND t1 >= start_ms THEN greatest(0, c1 - c0) END AS delta,
         (c0 IS NOT NULL AND t1 >= start_ms) AS observed
  FROM edges)"""

_SNAP_SQL = """
snap AS (SELECT session_id, t_ms, max(c) AS c FROM cnt GROUP BY ALL)"""


def _window_counts() -> dict:
    return {
        "level_up_selection_count": F.col("event_type") == "signup",
        "inventory_change_count": F.col("event_type").isin("signup", "purchase"),
        "consumable_reward_count": (F.col("event_type") == "view") & (F.col("k") >= 90),
    }


@query("five_second_windows", f"""
WITH {COUNTER_SQL}, {_SPINE_SQL}, {_SNAP_SQL}, {_BOUNDARY_SQL},
n AS (
  SELECT session_id, t_ms // {BIN_MS} * {BIN_MS} AS start_ms,
         count(*) FILTER (event_type = 'signup') AS a,
         count(*) FILTER (event_type IN ('signup', 'purchase')) AS b,
         count(*) FILTER (event_type = 'view' AND k >= 90) AS c
  FROM sig GROUP BY ALL)
SELECT bw.session_id, bw.start_ms, bw.end_ms, coalesce(a, 0) AS level_up_selection_count,
       coalesce(b, 0) AS inventory_change_count, coalesce(n.c, 0) AS consumable_reward_count,
       counter_start, counter_end, delta, observed
FROM bw LEFT JOIN n USING (session_id, start_ms)""")
def five_second_windows(spark, folder):
    rows = counters(spark, folder)
    counts = binning.count_by_bin(signals(spark, folder), BIN_MS, _window_counts())
    windows = binning.boundary_windows(rows, None, BIN_MS, value="c")
    names = list(_window_counts())
    return windows.join(counts, ["session_id", "start_ms"], "left").select(
        "session_id", "start_ms", "end_ms", *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in names],
        "counter_start", "counter_end", "delta", "observed")


@query("counter_boundary_windows", f"""
WITH {COUNTER_SQL}, {_SPINE_SQL}, {_SNAP_SQL}, {_BOUNDARY_SQL} SELECT * FROM bw""")
def counter_boundary_windows(spark, folder):
    return binning.boundary_windows(counters(spark, folder), None, BIN_MS, value="c")


_GOLD_SQL = COUNTER_SQL + f""",
ranked AS (
  SELECT session_id, t_ms // {BIN_MS} * {BIN_MS} AS start_ms, t_ms AS observed_at_ms,
         CASE WHEN event_id % 41 = 0 THEN c // 2 ELSE c END AS value,
         row_number() OVER (PARTITION BY session_id, t_ms // {BIN_MS} ORDER BY t_ms DESC, event_id DESC) AS rn FROM cnt),
bins AS (SELECT session_id, start_ms, observed_at_ms, value FROM ranked WHERE rn = 1)"""


def _gold_bins(spark, folder):
    rows = counters(spark, folder).withColumn("gold", F.expr("CASE WHEN event_id % 41 = 0 THEN c div 2 ELSE c END"))
    return binning.last_value_bins(rows, BIN_MS, value="gold")


@query("gold_bins", f"WITH {_GOLD_SQL} SELECT *, start_ms + {BIN_MS} AS end_ms FROM bins")
def gold_bins(spark, folder):
    return _gold_bins(spark, folder).withColumn("end_ms", F.col("start_ms") + BIN_MS)


@query("gold_bin_deltas", f"""
WITH {_GOLD_SQL},
l AS (SELECT *, lag(start_ms) OVER w AS p, lag(value) OVER w AS counter_start FROM bins
      WINDOW w AS (PARTITION BY session_id ORDER BY start_ms))
SELECT session_id, start_ms, observed_at_ms, value, counter_start, value - counter_start AS delta
FROM l WHERE start_ms = p + {BIN_MS} AND value >= counter_start""")
def gold_bin_deltas(spark, folder):
    return binning.bin_deltas(_gold_bins(spark, folder), BIN_MS)


@query("gold_segment_mean", f"""
WITH {_GOLD_SQL},
f AS (SELECT *, coalesce(start_ms - lag(start_ms) OVER w > 10000, true) AS break_before FROM bins
      WINDOW w AS (PARTITION BY session_id ORDER BY start_ms)),
g AS (SELECT *, CAST(sum(CAST(break_before AS INT)) OVER (PARTITION BY session_id ORDER BY start_ms) - 1 AS BIGINT) AS segment_index FROM f)
SELECT session_id, start_ms + {BIN_MS // 2} AS center_ms,
       round(avg(value) OVER (PARTITION BY session_id, segment_index ORDER BY start_ms
                              RANGE BETWEEN 15000 PRECEDING AND 15000 FOLLOWING), 6) AS value,
       break_before, segment_index FROM g""")
def gold_segment_mean(spark, folder):
    return binning.segment_means(_gold_bins(spark, folder), bin_ms=BIN_MS).withColumn("value", F.round("value", 6))


@query("centred_mean", f"""
WITH {SIGNAL_SQL}
SELECT session_id, event_id, t_ms, round(avg(value) OVER (PARTITION BY session_id ORDER BY t_ms
       RANGE BETWEEN 15000 PRECEDING AND 15000 FOLLOWING), 6) AS mean FROM sig""")
def centred_mean(spark, folder):
    rows = signals(spark, folder).select("session_id", "event_id", "t_ms", "value")
    return binning.centered_mean(rows, time_order(rows), value="value").select(
        "session_id", "event_id", "t_ms", F.round("mean", 6).alias("mean"))


COLOURS = {"blue": "click", "green": "view", "red": "purchase", "unresolved": "signup"}


def _quantity(colour: str):
    return F.sum(F.when(F.col("event_type") == COLOURS[colour], 1 + F.col("k") % 3).otherwise(0)).cast("long")


def _pickup_bins(rows):
    is_pickup = F.col("event_type") != "error"
    return rows.groupBy("session_id", binning.bin_start(F.col("t_ms"), BIN_MS).alias("start_ms")).agg(
        F.min(F.struct("t_ms", "event_id", "c")).alias("first"), F.max(F.struct("t_ms", "event_id", "c")).alias("last"),
        F.count_if(is_pickup).alias("pickup_count"), F.count_if(is_pickup & (F.col("k") < 10)).alias("review_count"),
        *[_quantity(colour).alias(colour) for colour in COLOURS])


_PICKUP_SQL = f"""
agg AS (
  SELECT session_id, t_ms // {BIN_MS} * {BIN_MS} AS start_ms,
         arg_min(c, t_ms * 1000000000 + event_id) AS c0, arg_max(c, t_ms * 1000000000 + event_id) AS c1,
         min(t_ms) AS clock_start_ms, max(t_ms) AS clock_end_ms,
         count(*) FILTER (event_type <> 'error') AS pickup_count,
         count(*) FILTER (event_type <> 'error' AND k < 10) AS review_count,
         CAST(sum(CASE WHEN event_type = 'click' THEN 1 + k % 3 ELSE 0 END) AS BIGINT) AS blue,
         CAST(sum(CASE WHEN event_type = 'view' THEN 1 + k % 3 ELSE 0 END) AS BIGINT) AS green,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 + k % 3 ELSE 0 END) AS BIGINT) AS red,
         CAST(sum(CASE WHEN event_type = 'signup' THEN 1 + k % 3 ELSE 0 END) AS BIGINT) AS unresolved
  FROM cnt GROUP BY ALL)"""


@query("reward_trajectory", f"""
WITH {COUNTER_SQL}, {_SPINE_SQL}, {_PICKUP_SQL}
SELECT sp.session_id, sp.start_ms, sp.end_ms, coalesce(c0, 0) AS kill_counter_start, coalesce(c1, 0) AS kill_counter_end,
       greatest(0, coalesce(c1 - c0, 0)) AS kills, clock_start_ms, clock_end_ms,
       coalesce(pickup_count, 0) AS pickup_count, coalesce(review_count, 0) AS review_count,
       coalesce(blue, 0) AS blue, coalesce(green, 0) AS green, coalesce(red, 0) AS red,
       coalesce(unresolved, 0) AS unresolved, coalesce(blue + green + red + unresolved, 0) AS total,
       c0 IS NOT NULL AS source_observed
FROM spine sp LEFT JOIN agg USING (session_id, start_ms)""")
def reward_trajectory(spark, folder):
    rows = counters(spark, folder)
    spine = binning.bin_spine(binning.observed_durations(rows, BIN_MS), F.col("duration_ms"), BIN_MS)
    joined = spine.join(_pickup_bins(rows), ["session_id", "start_ms"], "left")
    zero = lambda col: F.coalesce(col, F.lit(0)).cast("long")
    return joined.select(
        "session_id", "start_ms", "end_ms", zero(F.col("first.c")).alias("kill_counter_start"),
        zero(F.col("last.c")).alias("kill_counter_end"),
        F.greatest(F.lit(0), zero(F.col("last.c") - F.col("first.c"))).alias("kills"),
        F.col("first.t_ms").alias("clock_start_ms"), F.col("last.t_ms").alias("clock_end_ms"),
        zero(F.col("pickup_count")).alias("pickup_count"), zero(F.col("review_count")).alias("review_count"),
        *[zero(F.col(colour)).alias(colour) for colour in COLOURS],
        zero(sum((F.col(colour) for colour in list(COLOURS)[1:]), F.col("blue"))).alias("total"),
        F.col("first").isNotNull().alias("source_observed"))


@query("reward_trajectory_snapshots", f"""
WITH {COUNTER_SQL}, {_SPINE_SQL}, {_SNAP_SQL}, {_BOUNDARY_SQL}, {_PICKUP_SQL},
e AS (SELECT session_id, start_ms, end_ms, coalesce(c0, 0) AS s0, coalesce(c1, coalesce(c0, 0)) AS s1 FROM edges)
SELECT e.session_id, e.start_ms, e.end_ms, s0 AS kill_counter_start, s1 AS kill_counter_end,
       greatest(0, s1 - s0) AS kills, coalesce(blue + green + red + unresolved, 0) AS total
FROM e LEFT JOIN agg USING (session_id, start_ms)""")
def reward_trajectory_snapshots(spark, folder):
    rows = counters(spark, folder)
    windows = binning.boundary_windows(rows, None, BIN_MS, value="c")
    pickups = _pickup_bins(rows)
    # a bin without a snapshot at its start still shows the counter at its end
    joined = windows.join(pickups, ["session_id", "start_ms"], "left")
    first_end = F.coalesce(F.when(F.col("counter_end") > 0, F.col("counter_end")), F.col("closed_end"), F.lit(0))
    closed = rows.groupBy("session_id", (F.ceil(F.col("t_ms") / BIN_MS) - 1).cast("long").alias("b")).agg(
        F.max("c").alias("closed_end")).select("session_id", (F.col("b") * BIN_MS).alias("start_ms"), "closed_end")
    joined = joined.join(closed, ["session_id", "start_ms"], "left")
    return joined.select(
        "session_id", "start_ms", "end_ms", F.col("counter_start").alias("kill_counter_start"),
        first_end.cast("long").alias("kill_counter_end"),
        F.greatest(F.lit(0), first_end - F.col("counter_start")).cast("long").alias("kills"),
        F.coalesce(sum((F.col(colour) for colour in list(COLOURS)[1:]), F.col("blue")), F.lit(0)).cast("long").alias("total"))


@query("endpoint_bins", f"""
WITH {COUNTER_SQL},
s AS (SELECT session_id, t_ms // 1000 AS sec, event_id, c FROM cnt),
m AS (SELECT session_id, max(sec) AS m FROM s GROUP BY ALL),
e AS (SELECT session_id, b * 5 AS start_s, b * 5 + 5 AS end_s FROM (SELECT session_id, m, unnest(range(m // 5 + 2)) AS b FROM m) WHERE b * 5 + 5 <= ((m + 5) // 5) * 5),
l AS (SELECT session_id, sec, arg_max(c, event_id + 0) AS c FROM (
        SELECT *, max(event_id) OVER (PARTITION BY session_id, sec) AS top FROM s) WHERE event_id = top GROUP BY ALL)
SELECT e.session_id, start_s, end_s, l.sec AS matched_s, l.c AS value,
       printf('%02d:%02d-%02d:%02d', start_s // 60, start_s % 60, end_s // 60, end_s % 60) AS label
FROM e ASOF JOIN l ON e.session_id = l.session_id AND e.end_s >= l.sec""")
def endpoint_bins(spark, folder):
    rows = counters(spark, folder).withColumn("second", F.expr("t_ms div 1000"))
    return binning.endpoint_bins(rows, 5, second="second", value="c", tie="event_id").withColumn(
        "label", F.concat_ws("-", clock_label(F.col("start_s")), clock_label(F.col("end_s"))))


@query("rollup_5s", f"""
WITH {SIGNAL_SQL}, {_SPINE_SQL},
a AS (SELECT session_id, t_ms // {BIN_MS} * {BIN_MS} AS start_ms, count(*) AS jump_events, min(k % 10) AS level_min,
             max(k % 10) AS level_max, sum(value) FILTER (event_type <> 'error') AS s, avg(value) FILTER (event_type <> 'error') AS m,
             max(value) FILTER (event_type <> 'error') AS x,
             count(*) FILTER (event_type IN ('click', 'view')) AS visual_events, count(*) FILTER (k < 10) AS review_events,
             min(event_id) AS first_event_id, max(event_id) AS last_event_id
      FROM sig GROUP BY ALL)
SELECT session_id, start_ms, end_ms, coalesce(jump_events, 0) AS jump_events, level_min, level_max,
       round(coalesce(s, 0.0), 4) AS increase_sum, round(coalesce(m, 0.0), 4) AS increase_mean, round(coalesce(x, 0.0), 4) AS increase_max,
       coalesce(visual_events, 0) AS visual_events, coalesce(review_events, 0) AS review_events, first_event_id, last_event_id
FROM spine LEFT JOIN a USING (session_id, start_ms)""")
def rollup_5s(spark, folder):
    rows = signals(spark, folder)
    spine = binning.bin_spine(binning.observed_durations(rows, BIN_MS), F.col("duration_ms"), BIN_MS)
    counted = F.when(F.col("event_type") != "error", F.col("value"))
    agg = rows.groupBy("session_id", binning.bin_start(F.col("t_ms"), BIN_MS).alias("start_ms")).agg(
        F.count(F.lit(1)).alias("jump_events"), F.min(F.col("k") % 10).alias("level_min"), F.max(F.col("k") % 10).alias("level_max"),
        F.sum(counted).alias("increase_sum"), F.avg(counted).alias("increase_mean"), F.max(counted).alias("increase_max"),
        F.count_if(F.col("event_type").isin("click", "view")).alias("visual_events"), F.count_if(F.col("k") < 10).alias("review_events"),
        F.min("event_id").alias("first_event_id"), F.max("event_id").alias("last_event_id"))
    out = spine.join(agg, ["session_id", "start_ms"], "left")
    for name in ("jump_events", "visual_events", "review_events"):
        out = out.withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    for name in ("increase_sum", "increase_mean", "increase_max"):
        out = out.withColumn(name, F.round(F.coalesce(name, F.lit(0.0)), 4))
    return out


@query("rollup_members", f"""
WITH {SIGNAL_SQL}
SELECT session_id, t_ms // {BIN_MS} * {BIN_MS} AS start_ms, event_id,
       printf('%05d_%08d', session_id, t_ms) AS event_key FROM sig""")
def rollup_members(spark, folder):
    """The events behind each roll-up row, one row each instead of one joined string per bin."""
    return signals(spark, folder).select(
        "session_id", binning.bin_start(F.col("t_ms"), BIN_MS).alias("start_ms"), "event_id",
        F.format_string("%05d_%08d", "session_id", "t_ms").alias("event_key"))


@query("level_pattern", f"""
WITH {SIGNAL_SQL}, l AS (SELECT *, k % 25 AS level, CASE WHEN k >= 95 THEN NULL ELSE value END AS v FROM sig)
SELECT level, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(*) AS jump_events, count(*) FILTER (k < 95) AS complete_events,
       count(*) FILTER (k >= 95) AS saturated_events, round(min(v), 4) AS v_min, round(quantile_cont(v, 0.25), 4) AS v_q1,
       round(quantile_cont(v, 0.5), 4) AS v_median, round(avg(v), 4) AS v_mean, round(quantile_cont(v, 0.75), 4) AS v_q3,
       round(max(v), 4) AS v_max, count(*) FILTER (event_type = 'click' AND k < 95) AS single_blue_events,
       count(*) FILTER (event_type = 'signup') AS unresolved_events,
       round(avg(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 4) AS agreement_rate
FROM l GROUP BY level""")
def level_pattern(spark, folder):
    rows = signals(spark, folder).withColumns({
        "level": F.col("k") % 25, "v": F.when(F.col("k") < 95, F.col("value"))})
    spread = binning.group_quantiles(rows, ["level"], "v", {"v_q1": 0.25, "v_median": 0.5, "v_q3": 0.75})
    complete = F.col("k") < 95
    facts = rows.groupBy("level").agg(
        F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.count(F.lit(1)).alias("jump_events"),
        F.count_if(complete).alias("complete_events"), F.count_if(~complete).alias("saturated_events"),
        F.round(F.min("v"), 4).alias("v_min"), F.round(F.avg("v"), 4).alias("v_mean"), F.round(F.max("v"), 4).alias("v_max"),
        F.count_if((F.col("event_type") == "click") & complete).alias("single_blue_events"),
        F.count_if(F.col("event_type") == "signup").alias("unresolved_events"),
        F.round(F.avg(F.when(F.col("event_id") % 7 == 0, 1.0).otherwise(0.0)), 4).alias("agreement_rate"))
    return facts.join(spread, "level", "left").withColumns({name: F.round(name, 4) for name in ("v_q1", "v_median", "v_q3")})


@query("growth_by_level", f"""
WITH {SIGNAL_SQL}
SELECT k % 25 AS level, session_id % 3 AS crown_level, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS median_gain
FROM sig GROUP BY ALL""")
def growth_by_level(spark, folder):
    rows = signals(spark, folder).select(
        (F.col("k") % 25).alias("level"), (F.col("session_id") % 3).alias("crown_level"), "value")
    keys = ["level", "crown_level"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(binning.group_quantiles(rows, keys, "value", {"median_gain": 0.5}), keys).withColumn(
        "median_gain", F.round("median_gain", 4))
