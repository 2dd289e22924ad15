"""Pauses, lifecycles, state runs and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.functions.scalars import mean_median
from sessionlake.operators import binning, intervals as ops
from sessionlake.operators.ordering import last_seen, running_sum, time_order
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import SESSION_DURATION_MS, SIGNAL_SQL, signals

_W = "PARTITION BY session_id ORDER BY t_ms, event_id"
FPS = 10.0


@query("gameplay_segments", f"""
WITH {SIGNAL_SQL}, b AS (SELECT *, event_type = 'error' AND NOT coalesce(lag(event_type = 'error') OVER ({_W}), FALSE) AS begins FROM sig)
SELECT session_id, event_id, CAST(sum(CAST(begins AS INT)) OVER ({_W}) AS BIGINT) AS segment_id FROM b""")
def gameplay_segments(spark, folder):
    rows = signals(spark, folder).select("session_id", "t_ms", "event_id", "event_type")
    return ops.segment_ids(rows, time_order(rows), F.col("event_type") == "error").select("session_id", "event_id", "segment_id")


_PHASE_SQL = f"""
ph AS (SELECT * FROM (SELECT session_id, event_id, t_ms, row_number() OVER ({_W}) AS frame, event_type IN ('error', 'signup', 'view') AS blocked,
  CASE WHEN event_type = 'error' THEN CASE WHEN k % 3 = 0 THEN 'level_up_menu' ELSE 'level_up_transition' END
       WHEN event_type = 'signup' THEN 'treasure_menu' ELSE CASE WHEN k % 2 = 0 THEN 'level_up_menu' ELSE 'treasure_transition' END END AS phase
  FROM sig) WHERE event_id % 17 <> 0),
pi AS (SELECT *, frame - row_number() OVER (PARTITION BY session_id ORDER BY frame) AS g FROM ph WHERE blocked),
pp AS (SELECT session_id, g, phase, min(frame) AS f, max(frame) AS l, count(*) AS n FROM pi GROUP BY ALL),
pz AS (SELECT session_id, min(f) AS start_frame, max(l) + 1 AS end_frame, string_agg(phase, '|' ORDER BY f) AS phases,
       string_agg(CAST(n AS VARCHAR), '|' ORDER BY f) AS phase_frames, bool_or(phase = 'level_up_menu') AS has_level,
       bool_or(phase = 'treasure_menu') AS has_treasure, bool_and(phase LIKE 'treasure_%') AS all_treasure FROM pp GROUP BY session_id, g)"""


def phase_frames(spark, folder):
    rows = signals(spark, folder)
    order = time_order(rows)
    numbered = order.untag(order.running(order.tag(rows), frame=running_sum(F.lit(1).cast("long"))))
    odd = F.col("k") % 2 == 0
    phase = (F.when(F.col("event_type") == "error", F.when(F.col("k") % 3 == 0, "level_up_menu").otherwise("level_up_transition"))
             .when(F.col("event_type") == "signup", "treasure_menu").otherwise(F.when(odd, "level_up_menu").otherwise("treasure_transition")))
    return numbered.filter("event_id % 17 <> 0").select(
        "session_id", "event_id", "t_ms", "frame", F.col("event_type").isin("error", "signup", "view").alias("blocked"), phase.alias("phase"))


def pause_intervals(spark, folder):
    rows = phase_frames(spark, folder)
    return ops.blocked_intervals(rows, time_order(rows, by=("frame", "event_id")), frame="frame", blocked=F.col("blocked"), phase="phase")


@query("blocked_intervals", f"""
WITH {SIGNAL_SQL}, {_PHASE_SQL}
SELECT session_id, start_frame, end_frame, phases, phase_frames, CASE WHEN has_level THEN 'level_up_pause'
  WHEN has_treasure OR all_treasure THEN 'treasure_pause' ELSE 'unresolved_interruption_pause' END AS event_type FROM pz""")
def blocked_intervals(spark, folder):
    return pause_intervals(spark, folder).select(
        "session_id", "start_frame", "end_frame", F.array_join("phases", "|").alias("phases"),
        F.array_join(F.transform("phase_frames", lambda n: n.cast("string")), "|").alias("phase_frames"),
        ops.pause_type(F.col("phases")).alias("event_type"))


@query("frame_gaps", f"""
WITH {SIGNAL_SQL}, {_PHASE_SQL}
SELECT session_id, frame, frame - p AS step FROM (SELECT *, lag(frame) OVER (PARTITION BY session_id ORDER BY frame) AS p FROM ph) WHERE frame <> p + 1""")
def frame_gaps(spark, folder):
    """Places where the frame sequence is not contiguous."""
    rows = phase_frames(spark, folder).select("session_id", "event_id", "frame")
    order = time_order(rows, by=("frame", "event_id"))
    d = order.untag(order.frames(order.tag(rows), 1, p=lambda w: F.lag("frame").over(w)))
    return d.filter(F.col("frame") != F.col("p") + 1).select("session_id", "frame", (F.col("frame") - F.col("p")).alias("step"))


@query("fragment_merge")
def fragment_merge(spark, folder):
    fragments = pause_intervals(spark, folder)
    merged = ops.merge_fragments(fragments, time_order(fragments, by=("start_frame", "end_frame")), FPS)
    return merged.withColumn("phases", F.array_join("phases", "|"))


_ASSIGN_SQL = f"""
fr AS (SELECT session_id, start_frame * 2000 AS start_ms, end_frame * 2000 AS end_ms, start_frame AS fragment_id, phases FROM pz),
ev AS (SELECT session_id, t_ms // 5 AS t_ms, min(event_id) AS event_id FROM sig WHERE event_type = 'purchase' GROUP BY ALL),
cand AS (SELECT f.*, e.event_id, e.t_ms AS event_ms, CASE WHEN e.t_ms BETWEEN start_ms AND end_ms THEN 0
   WHEN e.t_ms > end_ms AND e.t_ms - end_ms <= 750 THEN e.t_ms - end_ms
   WHEN phases = 'level_up_transition' AND start_ms > e.t_ms AND start_ms - e.t_ms <= 2500 THEN start_ms - e.t_ms END AS d
   FROM fr f JOIN ev e ON e.session_id = f.session_id AND e.t_ms BETWEEN f.start_ms - 2500 AND f.end_ms + 750
   WHERE phases IN ('level_up_transition', 'level_up_menu', 'level_up_transition|level_up_menu', 'level_up_menu|level_up_transition')),
best AS (SELECT * FROM cand WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, fragment_id ORDER BY d, event_ms) = 1)"""


def _fragments_ms(spark, folder):
    frames = pause_intervals(spark, folder).select(
        "session_id", (F.col("start_frame") * 2000).alias("start_ms"), (F.col("end_frame") * 2000).alias("end_ms"),
        F.col("start_frame").alias("fragment_id"), "phases")
    events = signals(spark, folder).filter("event_type = 'purchase'").select("session_id", F.expr("t_ms div 5").alias("t_ms"), "event_id")
    return ops.assign_to_events(frames, events)


@query("pause_assignment", f"""
WITH {SIGNAL_SQL}, {_PHASE_SQL}, {_ASSIGN_SQL}
SELECT fr.session_id, fr.fragment_id, fr.phases, event_id, event_ms, d AS event_distance_ms
FROM fr LEFT JOIN best USING (session_id, fragment_id)""")
def pause_assignment(spark, folder):
    return _fragments_ms(spark, folder).select(
        "session_id", "fragment_id", F.array_join("phases", "|").alias("phases"), "event_id", "event_ms", "event_distance_ms")


@query("pause_reconciliation", f"""
WITH {SIGNAL_SQL}, {_PHASE_SQL}, {_ASSIGN_SQL}
SELECT session_id, event_id, event_ms, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS components,
       CAST(max(end_ms) - min(start_ms) - sum(end_ms - start_ms) AS BIGINT) AS merged_gap_ms FROM best GROUP BY ALL""")
def pause_reconciliation(spark, folder):
    """One pause per accepted selection; fragments do not overlap, so the gaps are the span minus their lengths."""
    matched = _fragments_ms(spark, folder).filter("event_id IS NOT NULL")
    return matched.groupBy("session_id", "event_id", "event_ms").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("components"),
        (F.max("end_ms") - F.min("start_ms") - F.sum(F.col("end_ms") - F.col("start_ms"))).alias("merged_gap_ms"))


@query("treasure_reconciliation", f"""
WITH {SIGNAL_SQL}, {_PHASE_SQL},
t AS (SELECT session_id, start_frame * 8000 AS s, end_frame * 8000 AS e FROM pz WHERE NOT has_level AND (has_treasure OR all_treasure)),
c AS (SELECT session_id, event_id, t_ms AS lo, t_ms + k * 40 AS hi FROM sig WHERE event_type = 'click' AND k >= 50)
SELECT c.session_id, c.event_id, least(lo, coalesce(min(s), lo)) AS start_ms, greatest(hi, coalesce(max(e), hi)) AS end_ms, count(s) > 0 AS matched
FROM c LEFT JOIN t ON t.session_id = c.session_id AND t.e >= c.lo - 500 AND t.s <= c.hi + 500 GROUP BY c.session_id, c.event_id, lo, hi""")
def treasure_reconciliation(spark, folder):
    pauses = pause_intervals(spark, folder).filter(ops.pause_type(F.col("phases")) == "treasure_pause").select(
        "session_id", (F.col("start_frame") * 8000).alias("start_ms"), (F.col("end_frame") * 8000).alias("end_ms"))
    chests = signals(spark, folder).filter("event_type = 'click' AND k >= 50").select(
        "session_id", "event_id", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + F.col("k") * 40).alias("end_ms"))
    return ops.bridge_with_evidence(pauses, chests).select("session_id", "event_id", "start_ms", "end_ms", "matched")


_SPAN_SQL = """
sp AS (SELECT session_id, event_id, event_type, t_ms AS start_ms, t_ms + k * 50 AS end_ms FROM sig WHERE event_type IN ('error', 'signup', 'purchase') AND k > 0)"""


def blocking_spans(spark, folder):
    return signals(spark, folder).filter("event_type IN ('error', 'signup', 'purchase') AND k > 0").select(
        "session_id", "event_id", "event_type", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + F.col("k") * 50).alias("end_ms"))


def merged_sql(slack: int = 0) -> str:
    return f"""
sm AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sp),
sg AS (SELECT *, sum(CASE WHEN r IS NULL OR start_ms > r + {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_ms, event_id) AS g FROM sm)"""


@query("merged_intervals", f"""
WITH {SIGNAL_SQL}, {_SPAN_SQL}, {merged_sql()}
SELECT session_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS event_types,
       count(*) AS events FROM sg GROUP BY session_id, g""")
def merged_intervals(spark, folder):
    types = F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("event_types")
    return ops.merge_overlapping(blocking_spans(spark, folder), aggs=[types, F.count(F.lit(1)).alias("events")])


@query("merged_interval_members", f"""
WITH {SIGNAL_SQL}, {_SPAN_SQL}, {merged_sql()}
SELECT session_id, event_id, min(start_ms) OVER (PARTITION BY session_id, g) AS interval_start_ms FROM sg""")
def merged_interval_members(spark, folder):
    """The events behind every merged interval, one row each."""
    from sessionlake.operators.ordering import running_max

    spans = blocking_spans(spark, folder)
    order = time_order(spans, by=("start_ms", "event_id"))
    d = order.running(order.tag(spans), reach=running_max(F.col("end_ms"), exclusive=True))
    opens = F.col("reach").isNull() | (F.col("start_ms") > F.col("reach"))
    d = order.running(d.withColumn("opened", F.when(opens, F.col("start_ms"))), interval_start_ms=last_seen(F.col("opened")))
    return order.untag(d).select("session_id", "event_id", "interval_start_ms")


@query("search_windows", f"""
WITH {SIGNAL_SQL}, sp AS (SELECT session_id, event_id, greatest(0, t_ms - 15000) AS start_ms, least({SESSION_DURATION_MS}, t_ms + 5000) AS end_ms
  FROM sig WHERE event_type = 'signup'), {merged_sql(250)}
SELECT session_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS transitions FROM sg GROUP BY session_id, g""")
def search_windows(spark, folder):
    windows = signals(spark, folder).filter("event_type = 'signup'").select(
        "session_id", "event_id", F.greatest(F.lit(0), F.col("t_ms") - 15_000).alias("start_ms"),
        F.least(F.lit(SESSION_DURATION_MS), F.col("t_ms") + 5_000).alias("end_ms"))
    return ops.merge_overlapping(windows, slack=250, aggs=[F.count(F.lit(1)).alias("transitions")])


def _run_sql(member: str, gap: int, breaker: str | None) -> str:
    """Runs of member rows: by time gap and by rows that break them."""
    broken = f"sum(CASE WHEN {breaker} THEN 1 ELSE 0 END) OVER ({_W})" if breaker else "0"
    return f"""
ra AS (SELECT *, {member} AS m, {broken} AS br FROM feat),
rb AS (SELECT *, lag(t_ms) OVER ({_W}) AS pt, lag(br) OVER ({_W}) AS pb FROM ra WHERE m),
rc AS (SELECT *, sum(CASE WHEN pt IS NULL OR t_ms - pt > {gap} OR br <> pb THEN 1 ELSE 0 END) OVER ({_W}) AS g FROM rb)"""


_FEATURE_SQL = """
feat AS (SELECT session_id, event_id, t_ms, event_type, k, value, event_type = 'error' AS paused, event_type IN ('click', 'view', 'purchase') AND k >= 10 AS chest_like,
   event_type <> 'signup' AS observable, k % 6 AS orbs, (k % 50) / 50.0 AS beam FROM sig)"""


def features(spark, folder):
    return signals(spark, folder).select(
        "session_id", "event_id", "t_ms", "event_type", "k", "value", (F.col("event_type") == "error").alias("paused"),
        (F.col("event_type").isin("click", "view", "purchase") & (F.col("k") >= 10)).alias("chest_like"),
        (F.col("event_type") != "signup").alias("observable"), (F.col("k") % 6).alias("orbs"), (F.col("k") % 50 / 50.0).alias("beam"))


@query("chest_intervals", f"""
WITH {SIGNAL_SQL}, {_FEATURE_SQL}, {_run_sql('chest_like', 20000, 'paused')},
x AS (SELECT session_id, g, min(t_ms) AS start_ms, max(t_ms) + 250 AS end_ms, max(orbs) AS reward_count, count(*) AS samples,
      quantile_cont(beam, 0.5) AS beam FROM rc GROUP BY ALL)
SELECT session_id, start_ms, end_ms, reward_count, samples, 'loot_box_tier_' || CASE reward_count WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS event_type,
       round(CAST(beam AS DOUBLE), 6) AS median_beam FROM x WHERE end_ms - start_ms >= 1500 AND reward_count IN (1, 3, 5)""")
def chest_intervals(spark, folder):
    """Chest lifecycles; only the 1, 3 or 5 item reveal makes one publishable."""
    rows = features(spark, folder)
    d = ops.runs(rows, time_order(rows), F.col("chest_like"), gap_ms=20_000, interrupted=F.col("paused"))
    keys = ["session_id", "island"]
    groups = d.groupBy(*keys).agg(F.min("t_ms").alias("start_ms"), (F.max("t_ms") + 250).alias("end_ms"),
                                  F.max("orbs").alias("reward_count"), F.count(F.lit(1)).alias("samples"))
    accepted = groups.filter((F.col("end_ms") - F.col("start_ms") >= 1_500) & F.col("reward_count").isin(1, 3, 5))
    beams = binning.group_quantiles(d, keys, "beam", {"median_beam": 0.5})
    tier = F.when(F.col("reward_count") == 1, 1).when(F.col("reward_count") == 3, 2).otherwise(3)
    return accepted.join(beams, keys).select(
        "session_id", "start_ms", "end_ms", "reward_count", "samples", F.concat(F.lit("loot_box_tier_"), tier.cast("string")).alias("event_type"),
        F.round("median_beam", 6).alias("median_beam"))


@query("fever_intervals", f"""
WITH {SIGNAL_SQL}, {_FEATURE_SQL}, {_run_sql("k >= 15 AND NOT paused", 12000, 'paused')}
SELECT session_id, min(t_ms) AS start_ms, max(t_ms) + 250 AS end_ms, count(*) AS samples FROM rc GROUP BY session_id, g
HAVING max(t_ms) + 250 - min(t_ms) >= 1000 AND bool_or(k >= 90)""")
def fever_intervals(spark, folder):
    """Effect intervals need the fixed label at least once."""
    rows = features(spark, folder)
    d = ops.runs(rows, time_order(rows), (F.col("k") >= 15) & ~F.col("paused"), gap_ms=12_000, interrupted=F.col("paused"))
    return d.groupBy("session_id", "island").agg(
        F.min("t_ms").alias("start_ms"), (F.max("t_ms") + 250).alias("end_ms"), F.count(F.lit(1)).alias("samples"),
        F.bool_or(F.col("k") >= 90).alias("label")
    ).filter((F.col("end_ms") - F.col("start_ms") >= 1_000) & F.col("label")).drop("island", "label")


@query("freeze_intervals", f"""
WITH {SIGNAL_SQL}, {_FEATURE_SQL}, {_run_sql("k < 60", 15000, 'NOT (k < 60)')}
SELECT session_id, min(t_ms) AS start_ms, max(t_ms) + 10000 AS end_ms, count(*) AS samples FROM rc GROUP BY session_id, g
HAVING max(t_ms) + 10000 - min(t_ms) >= 15000""")
def freeze_intervals(spark, folder):
    rows = features(spark, folder)
    d = ops.runs(rows, time_order(rows), F.col("k") < 60, gap_ms=15_000, breaks_on_other=True)
    return d.groupBy("session_id", "island").agg(
        F.min("t_ms").alias("start_ms"), (F.max("t_ms") + 10_000).alias("end_ms"), F.count(F.lit(1)).alias("samples")
    ).filter(F.col("end_ms") - F.col("start_ms") >= 15_000).drop("island")


@query("vacuum_intervals", f"""
WITH {SIGNAL_SQL}, {_FEATURE_SQL}, {_run_sql("event_type <> 'error'", 15000, "event_type = 'error'")},
x AS (SELECT session_id, min(t_ms) AS start_ms, max(t_ms) + 10000 AS end_ms, count(*) AS samples, arg_min(k, t_ms * 1000000000 + event_id) AS a,
      arg_max(k // 2, t_ms * 1000000000 + event_id) AS b FROM rc GROUP BY session_id, g)
SELECT session_id, start_ms, end_ms, samples, a AS start_components, b AS end_components, round((a - b) / greatest(a, 1), 6) AS depletion
FROM x WHERE samples >= 3 AND (a - b) / greatest(a, 1) >= 0.25""")
def vacuum_intervals(spark, folder):
    rows = features(spark, folder)
    d = ops.runs(rows, time_order(rows), ~F.col("paused"), gap_ms=15_000, breaks_on_other=True)
    position = F.struct("t_ms", "event_id")
    x = d.groupBy("session_id", "island").agg(
        F.min("t_ms").alias("start_ms"), (F.max("t_ms") + 10_000).alias("end_ms"), F.count(F.lit(1)).alias("samples"),
        F.min_by("k", position).alias("start_components"), F.max_by(F.expr("k div 2"), position).alias("end_components"))
    depletion = (F.col("start_components") - F.col("end_components")) / F.greatest("start_components", F.lit(1))
    return x.withColumn("depletion", depletion).filter("samples >= 3 AND depletion >= 0.25").withColumn(
        "depletion", F.round("depletion", 6)).drop("island")


_STATE_SQL = f"""
st AS (SELECT session_id, event_id, t_ms, CASE event_type WHEN 'error' THEN 'game_over' WHEN 'signup' THEN 'results' WHEN 'view' THEN 'pregame_menu' ELSE 'gameplay_or_overlay' END AS state FROM sig),
sr AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER ({_W}) THEN 1 ELSE 0 END AS f FROM st),
su AS (SELECT *, sum(f) OVER ({_W}) AS run FROM sr),
si AS (SELECT session_id, run, state, min(t_ms) AS lower_ms, max(t_ms) + 500 AS upper_ms, count(*) AS samples FROM su GROUP BY ALL HAVING count(*) >= 2),
sd AS (SELECT *, row_number() OVER (PARTITION BY session_id, state ORDER BY run) AS nth FROM si WHERE state <> 'gameplay_or_overlay')"""


@query("status_runs", f"""
WITH {SIGNAL_SQL}, {_STATE_SQL}
SELECT session_id, state, lower_ms, upper_ms, samples, CASE state WHEN 'game_over' THEN 'death' ELSE 'match_transition' END AS event_type
FROM sd WHERE state <> 'game_over' OR nth = 1
UNION ALL SELECT session_id, state, lower_ms, upper_ms, samples, 'achievement' FROM sd WHERE state = 'results'""")
def status_runs(spark, folder):
    """Screen states that last; only the first death of a session counts, results also show the achievement card."""
    # fixed values: screen state of each source event
    state = (F.when(F.col("event_type") == "error", "game_over").when(F.col("event_type") == "signup", "results")
             .when(F.col("event_type") == "view", "pregame_menu").otherwise("gameplay_or_overlay"))
    rows = signals(spark, folder).select("session_id", "event_id", "t_ms", state.alias("state"))
    d = ops.state_runs(rows, time_order(rows), "state").groupBy("session_id", "run", "state").agg(
        F.min("t_ms").alias("lower_ms"), (F.max("t_ms") + 500).alias("upper_ms"), F.count(F.lit(1)).alias("samples")
    ).filter("samples >= 2 AND state <> 'gameplay_or_overlay'")
    over = F.col("state") == "game_over"
    first_death = d.filter(over).groupBy("session_id").agg(F.min("run").alias("first_death"))
    d = d.join(first_death, "session_id", "left").filter(~over | (F.col("run") == F.col("first_death")))
    kinds = (F.when(over, F.array(F.lit("death"))).when(F.col("state") == "results", F.array(F.lit("match_transition"), F.lit("achievement")))
             .otherwise(F.array(F.lit("match_transition"))))
    return d.select("session_id", "state", "lower_ms", "upper_ms", "samples", F.explode(kinds).alias("event_type"))


@query("turn_state_runs", """
WITH t AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS f FROM conversations),
g AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
SELECT conv_id, role AS state, min(turn) AS start_frame, max(turn) + 1 AS end_frame, count(*) AS samples FROM g GROUP BY conv_id, role, run""")
def turn_state_runs(spark, folder):
    from sessionlake.sources.telemetry import table

    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.col("role").alias("state"))
    d = ops.state_runs(rows, time_order(rows, "conv_id", ("turn", "turn")), "state")
    return d.groupBy("conv_id", "state", "run").agg(
        F.min("turn").alias("start_frame"), (F.max("turn") + 1).alias("end_frame"), F.count(F.lit(1)).alias("samples")).drop("run")


_HIST_SQL = f"""
hs AS (SELECT *, sum(CASE WHEN observable THEN 0 ELSE 1 END) OVER ({_W}) AS gap FROM feat),
hm AS (SELECT *, count(value) OVER h AS n, quantile_cont(value, 0.5) OVER h AS motion_base, quantile_cont(k / 100.0, 0.5) OVER h AS tint_base FROM hs
       WHERE observable WINDOW h AS (PARTITION BY session_id, gap ORDER BY t_ms, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"""


@query("rolling_baseline_flags", f"""
WITH {SIGNAL_SQL}, {_FEATURE_SQL}, {_HIST_SQL}
SELECT f.session_id, f.event_id, f.observable, CASE WHEN n >= 4 THEN round(motion_base, 6) END AS motion_baseline,
       CASE WHEN n >= 4 THEN round(CAST(tint_base AS DOUBLE), 6) END AS tint_baseline,
       coalesce(n >= 4 AND motion_base >= 0.015 AND h.value / greatest(motion_base, 0.000001) <= 0.42 AND h.k / 100.0 - tint_base >= 0.008, FALSE) AS freeze_like
FROM feat f LEFT JOIN hm h USING (session_id, event_id)""")
def rolling_baseline_flags(spark, folder):
    """Motion far below and tint above the recent observable past."""
    rows = features(spark, folder).select("session_id", "event_id", "t_ms", "observable", "value", "k")
    d = ops.rolling_history(rows, time_order(rows), F.col("observable"), 8, motion=F.col("value"), tint=F.col("k") / 100.0)
    enough = F.coalesce(F.size("motion_history") >= 4, F.lit(False))
    d = d.withColumns({"mb": F.when(enough, mean_median(F.col("motion_history"))), "tb": F.when(enough, mean_median(F.col("tint_history")))})
    like = (enough & (F.col("mb") >= 0.015) & (F.col("value") / F.greatest("mb", F.lit(1e-6)) <= 0.42) & (F.col("k") / 100.0 - F.col("tb") >= 0.008))
    return d.select("session_id", "event_id", "observable", F.round("mb", 6).alias("motion_baseline"), F.round("tb", 6).alias("tint_baseline"),
                    F.coalesce(like, F.lit(False)).alias("freeze_like"))


@query("vacuum_flags", f"""
WITH {SIGNAL_SQL}, {_FEATURE_SQL}, {_HIST_SQL},
v AS (SELECT *, quantile_cont(k, 0.5) OVER (PARTITION BY session_id, gap ORDER BY t_ms, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS base FROM hs WHERE observable)
SELECT f.session_id, f.event_id, CASE WHEN f.observable THEN round(coalesce(base, 0.0), 6) END AS baseline,
       coalesce(f.observable AND f.k >= greatest(10, coalesce(base, 0) * 1.6) AND f.beam >= 0.5, FALSE) AS vacuum_like
FROM feat f LEFT JOIN v USING (session_id, event_id)""")
def vacuum_flags(spark, folder):
    rows = features(spark, folder).select("session_id", "event_id", "t_ms", "observable", "k", "beam")
    d = ops.rolling_history(rows, time_order(rows), F.col("observable"), 8, k=F.col("k"))
    base = F.when(F.col("observable"), F.coalesce(mean_median(F.col("k_history")), F.lit(0.0)))
    like = F.col("observable") & (F.col("k") >= F.greatest(F.lit(10.0), base * 1.6)) & (F.col("beam") >= 0.5)
    return d.select("session_id", "event_id", F.round(base, 6).alias("baseline"), F.coalesce(like, F.lit(False)).alias("vacuum_like"))


@query("coverage_spans", f"""
WITH {SIGNAL_SQL}, d AS (SELECT session_id, max(t_ms) - 20000 AS duration_ms FROM sig GROUP BY ALL),
w AS (SELECT session_id, duration_ms, b AS window_id, b * 60000 AS start_ms, b * 60000 + 60000 AS end_ms FROM d, range(12) AS r(b)),
gp AS (SELECT session_id, t_ms AS s, t_ms + k * 100 AS e FROM sig WHERE event_type = 'error' AND k >= 60)
SELECT session_id, window_id, CASE WHEN duration_ms <= start_ms THEN 'absent' WHEN duration_ms < end_ms THEN 'partial'
  WHEN EXISTS (SELECT 1 FROM gp WHERE gp.session_id = w.session_id AND gp.s < w.end_ms AND gp.e > w.start_ms) THEN 'gap' ELSE 'span-only' END AS status FROM w""")
def coverage_spans(spark, folder):
    rows = signals(spark, folder)
    sessions = rows.groupBy("session_id").agg((F.max("t_ms") - 20_000).alias("duration_ms"))
    windows = sessions.withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")))).withColumns({
        "start_ms": F.col("window_id") * 60_000, "end_ms": F.col("window_id") * 60_000 + 60_000})
    gaps = rows.filter("event_type = 'error' AND k >= 60").select(
        "session_id", "event_id", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + F.col("k") * 100).alias("end_ms"))
    return ops.span_status(windows, gaps, duration="duration_ms").select("session_id", "window_id", "status")


@query("stable_slot_levels", """
WITH s AS (SELECT l_orderkey % 500 AS menu, l_orderkey, l_linenumber AS slot, CAST(l_quantity AS BIGINT) % 2 + 1 AS level FROM lineitem),
n AS (SELECT menu, count(DISTINCT l_orderkey) AS snapshots FROM s GROUP BY ALL),
c AS (SELECT menu, slot, level, count(*) AS support FROM s GROUP BY ALL)
SELECT menu, slot, level, support, snapshots FROM c JOIN n USING (menu) WHERE snapshots >= 2 AND support / snapshots >= 0.6""")
def stable_slot_levels(spark, folder):
    """Per slot the reading that at least 60% of the snapshots of a menu agree on; a missing reading counts as none."""
    from sessionlake.sources.telemetry import table

    rows = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("menu"), "l_orderkey", F.col("l_linenumber").alias("slot"),
        (F.col("l_quantity").cast("long") % 2 + 1).alias("level"))
    snapshots = rows.groupBy("menu", "l_orderkey").agg(F.lit(1).alias("one")).groupBy("menu").agg(F.count("one").alias("snapshots"))
    support = rows.groupBy("menu", "slot", "level").agg(F.count(F.lit(1)).alias("support"))
    return support.join(snapshots, "menu").filter((F.col("snapshots") >= 2) & (F.col("support") / F.col("snapshots") >= 0.6))


@query("menu_deduplication")
def menu_deduplication(spark, folder):
    rows = signals(spark, folder).filter("event_type = 'click'").select(
        "session_id", "event_id", F.expr("t_ms div 20000 * 20000 + k % 300").alias("start_ms"),
        F.expr("t_ms div 20000 * 20000 + 2000 + k % 700").alias("end_ms"), F.expr("concat('item_', k % 2)").alias("item"),
        (F.col("event_id") % 2).alias("selected_index"))
    return ops.distinct_menus(rows, time_order(rows, by=("start_ms", "event_id")))


@query("menu_segments")
def menu_segments(spark, folder):
    rows = signals(spark, folder).select(
        "session_id", "event_id", "t_ms", F.expr("t_ms div 60000").alias("window_id"),
        F.when(F.col("event_type") == "error", 0).otherwise(3 + (F.col("k") > 80).cast("long")).alias("options"), (F.col("k") >= 20).alias("reliable"))
    return ops.menu_segments(rows, time_order(rows), window="window_id", options="options", reliable="reliable")
