"""Coded reward sheets, inter-event times and point-process models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.functions.scalars import clock_label, interval_bounds
from sessionlake.operators import pointprocess as ops
from sessionlake.operators.binning import observed_durations
from sessionlake.operators.ordering import running_sum, time_order
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import SIGNAL_SQL, signals

BIN_MS = 5_000
GRID_MS = 30_000
TYPES = ("click", "purchase", "view")
KINDS = ("click", "error", "purchase", "signup", "view")


def coded_sheet(spark, folder):
    """Rows are one-minute windows of a session, columns are event counts."""
    rows = signals(spark, folder)
    wide = rows.groupBy("session_id", F.expr("t_ms div 60000").alias("w")).agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in TYPES])
    return wide.withColumns({"start_s": F.col("w") * 60.0, "end_s": F.col("w") * 60.0 + 60.0}).drop("w")


_SHEET_SQL = """
sh AS (SELECT session_id, t_ms // 60000 * 60.0 AS start_s, t_ms // 60000 * 60.0 + 60.0 AS end_s, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM sig GROUP BY ALL)"""


@query("interval_to_events", f"""
WITH {SIGNAL_SQL}, {_SHEET_SQL}, u AS (SELECT session_id, start_s, end_s, 'click' AS event_type, click AS n, 0 AS off FROM sh UNION ALL SELECT session_id, start_s, end_s, 'purchase', purchase, click FROM sh UNION ALL SELECT session_id, start_s, end_s, 'view', view, click + purchase FROM sh)
SELECT session_id, event_type, i, n AS coded_value, round(CAST(start_s + i * (end_s - start_s) / (n + 1) + (off + i - 1) * 0.000001 AS DOUBLE), 6) AS event_time_s FROM u, LATERAL (SELECT unnest(range(1, n + 1)) AS i)""")
def interval_to_events(spark, folder):
    d = ops.interval_events(coded_sheet(spark, folder), ["session_id"], "start_s", "end_s", TYPES)
    return d.withColumn("event_time_s", F.round("event_time_s", 6))


@query("interval_labels", f"""
WITH {SIGNAL_SQL}, l AS (SELECT event_id, t_ms // 1000 AS a, t_ms // 1000 + k - 20 AS b FROM sig),
t AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN printf('%02d:%02d', a // 60, a % 60) || ' – ' || printf('%02d:%02d', greatest(b, 0) // 60, greatest(b, 0) % 60) ELSE printf('%02d:%02d', a // 60, a % 60) || '-' || printf('%02d:%02d', greatest(b, 0) // 60, greatest(b, 0) % 60) END AS label FROM l)
SELECT event_id, label, CASE WHEN event_id % 13 <> 0 THEN CAST(a AS DOUBLE) END AS start_s, CASE WHEN event_id % 13 <> 0 THEN CAST(greatest(b, 0) AS DOUBLE) END AS end_s, CASE WHEN event_id % 13 <> 0 THEN CAST(greatest(b, 0) - a AS DOUBLE) END AS duration_s FROM t""")
def interval_labels(spark, folder):
    a, b = F.expr("t_ms div 1000"), F.greatest(F.expr("t_ms div 1000 + k - 20"), F.lit(0))
    dash = F.when(F.col("event_id") % 7 == 0, " – ").otherwise("-")
    rows = signals(spark, folder).select("event_id", F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.concat(clock_label(a), dash, clock_label(b))).alias("label"))
    return rows.select("event_id", "label", interval_bounds(F.col("label")).alias("i")).select("event_id", "label", "i.*")


@query("column_roles", """
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS coder, CAST(event_id AS VARCHAR) AS stamp, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS kills, CASE WHEN event_id % 3 = 0 THEN '1' ELSE event_type END AS mixed, props AS remark_notes FROM events)
SELECT 'Coder' AS column_name, 'rater' AS role, avg(CASE WHEN TRY_CAST(coder AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) AS numeric_share FROM s
UNION ALL SELECT 'Time Stamp', 'timestamp', avg(CASE WHEN TRY_CAST(stamp AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) FROM s
UNION ALL SELECT 'Kills', CASE WHEN avg(CASE WHEN TRY_CAST(kills AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) > 0.5 THEN 'reward' ELSE 'ignored' END, avg(CASE WHEN TRY_CAST(kills AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) FROM s
UNION ALL SELECT 'Mixed', CASE WHEN avg(CASE WHEN TRY_CAST(mixed AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) > 0.5 THEN 'reward' ELSE 'ignored' END, avg(CASE WHEN TRY_CAST(mixed AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) FROM s
UNION ALL SELECT 'Remark Notes', 'notes', avg(CASE WHEN TRY_CAST(remark_notes AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) FROM s""")
def column_roles(spark, folder):
    from sessionlake.sources.telemetry import table

    odd = F.col("event_id") % 3 == 0
    sheet = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("Coder"), F.col("event_id").cast("string").alias("Time Stamp"), F.when(odd, "").otherwise(F.col("value").cast("string")).alias("Kills"),
        F.when(odd, "1").otherwise(F.col("event_type")).alias("Mixed"), F.col("props").alias("Remark Notes"))
    return ops.column_roles(sheet)


_GAP_SQL = """
gp AS (SELECT session_id, event_type, (t_ms - lag(t_ms) OVER (PARTITION BY session_id, event_type ORDER BY t_ms, event_id)) / 1000.0 AS gap_s FROM sig),
gk AS (SELECT * FROM gp WHERE gap_s > 0.0001)"""


def _typed_gaps(spark, folder):
    return ops.gaps(signals(spark, folder), ["session_id", "event_type"])


@query("iet_summary", f"""
WITH {SIGNAL_SQL}, g AS (SELECT session_id, (t_ms - lag(t_ms) OVER (PARTITION BY session_id ORDER BY t_ms, event_id)) / 1000.0 AS gap_s FROM sig)
SELECT session_id, count(*) AS gaps, round(avg(gap_s), 6) AS mean_s, round(stddev_pop(gap_s), 6) AS std_s, min(gap_s) AS min_s, max(gap_s) AS max_s, round(quantile_cont(gap_s, 0.5), 6) AS median_s FROM g WHERE gap_s > 0.0001 GROUP BY ALL""")
def iet_summary(spark, folder):
    d = ops.gap_summary(ops.gaps(signals(spark, folder), ["session_id"]), ["session_id"])
    return d.withColumns({name: F.round(name, 6) for name in ("mean_s", "std_s", "median_s")})


@query("iet_by_type", f"""
WITH {SIGNAL_SQL}, {_GAP_SQL}
SELECT event_type, count(*) AS gaps, round(avg(gap_s), 6) AS mean_s, round(stddev_pop(gap_s), 6) AS std_s, min(gap_s) AS min_s, max(gap_s) AS max_s, round(quantile_cont(gap_s, 0.5), 6) AS median_s FROM gk GROUP BY ALL""")
def iet_by_type(spark, folder):
    return ops.gap_summary(_typed_gaps(spark, folder), ["event_type"]).withColumns({name: F.round(name, 6) for name in ("mean_s", "std_s", "median_s")})


@query("iet_histogram", f"""
WITH {SIGNAL_SQL}, {_GAP_SQL}, c AS (SELECT event_type, CASE WHEN count(*) > 5 THEN quantile_cont(gap_s, 0.95) ELSE max(gap_s) END AS cap FROM gk GROUP BY ALL),
k2 AS (SELECT gk.* FROM gk JOIN c USING (event_type) WHERE gap_s <= cap), e AS (SELECT event_type, min(gap_s) AS lo, max(gap_s) AS hi FROM k2 GROUP BY ALL)
SELECT event_type, CAST(coalesce(least(floor((gap_s - lo) / (hi - lo) * 30), 29), 0) AS BIGINT) AS bin, count(*) AS n FROM k2 JOIN e USING (event_type) GROUP BY ALL""")
def iet_histogram(spark, folder):
    return ops.gap_histogram(_typed_gaps(spark, folder), "event_type")


@query("cumulative_events", f"""
WITH {SIGNAL_SQL} SELECT session_id, event_id, t_ms, row_number() OVER (PARTITION BY session_id ORDER BY t_ms, event_id) AS cumulative_events FROM sig""")
def cumulative_events(spark, folder):
    rows = signals(spark, folder).select("session_id", "event_id", "t_ms")
    order = time_order(rows)
    return order.untag(order.running(order.tag(rows), cumulative_events=running_sum(F.lit(1).cast("long"))))


@query("interval_heat_map", f"WITH {SIGNAL_SQL}, {_SHEET_SQL} SELECT session_id, CAST(start_s AS DOUBLE) AS start_s, click, purchase, view, click + purchase + view AS total FROM sh")
def interval_heat_map(spark, folder):
    return coded_sheet(spark, folder).withColumn("total", F.col("click") + F.col("purchase") + F.col("view")).drop("end_s")


@query("rater_type_counts", f"WITH {SIGNAL_SQL} SELECT session_id % 3 AS rater, event_type, count(*) AS n FROM sig GROUP BY ALL")
def rater_type_counts(spark, folder):
    return signals(spark, folder).groupBy((F.col("session_id") % 3).alias("rater"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("top_types", f"WITH {SIGNAL_SQL} SELECT event_type, count(*) AS n FROM sig GROUP BY ALL ORDER BY n DESC, event_type LIMIT 3")
def top_types(spark, folder):
    """The three most frequent event types."""
    return signals(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


def _end_ms(spark, folder) -> int:
    """The observation ends for all sessions with the bin that holds the last event."""
    return signals(spark, folder).agg((F.floor(F.max("t_ms") / BIN_MS) + 1) * BIN_MS).first()[0] or BIN_MS


def _exposure(end_ms: int):
    return F.lit(end_ms / 1000.0) * F.count_distinct("session_id")


_POISSON_SQL = f"""
en AS (SELECT (max(t_ms) // {BIN_MS} + 1) * {BIN_MS} AS end_ms FROM sig),
ps AS (SELECT event_type, count(*) AS n, count(DISTINCT session_id) * max(end_ms) / 1000.0 AS expo FROM sig, en GROUP BY event_type),
pf AS (SELECT event_type, n, expo, n / expo AS rate, n * ln(n / expo) - n AS loglik FROM ps)"""


@query("poisson_fit", f"""
WITH {SIGNAL_SQL}, {_POISSON_SQL} SELECT event_type, n, CAST(expo AS DOUBLE) AS exposure_s, round(CAST(rate AS DOUBLE), 8) AS rate, round(CAST(loglik AS DOUBLE), 4) AS loglik, round(CAST(2 - 2 * loglik AS DOUBLE), 4) AS aic, round(CAST(ln(n) - 2 * loglik AS DOUBLE), 4) AS bic FROM pf""")
def poisson_fit(spark, folder):
    d = ops.poisson_fit(signals(spark, folder), ["event_type"], _exposure(_end_ms(spark, folder)))
    return d.withColumns({"rate": F.round("rate", 8), **{name: F.round(name, 4) for name in ("loglik", "aic", "bic")}})


BETAS = (0.05, 0.5, 5.0)
MU, ALPHA = 0.015, 0.2

_HAWKES_SQL = f"""
bt(beta) AS (VALUES (0.05), (0.5), (5.0)),
eh AS (SELECT (max(t_ms) // {BIN_MS} + 1) * {BIN_MS} AS end_ms FROM sig),
pr AS (SELECT end_ms, a.session_id, a.event_type, a.event_id, a.t_ms, beta, sum(CASE WHEN (b.t_ms, b.event_id) < (a.t_ms, a.event_id) THEN exp(-beta * (a.t_ms - b.t_ms) / 1000.0) ELSE 0 END) AS h
   FROM sig a JOIN sig b ON a.session_id = b.session_id AND a.event_type = b.event_type, bt, eh GROUP BY ALL),
hl AS (SELECT event_type, beta, count(*) AS n, sum(ln({MU} + {ALPHA} * beta * h)) - {MU} * max(end_ms) / 1000.0 * count(DISTINCT session_id) - {ALPHA} * sum(1 - exp(-beta * (end_ms - t_ms) / 1000.0)) AS loglik FROM pr GROUP BY ALL)"""


def _history(spark, folder):
    rows = signals(spark, folder).select("session_id", "event_type", "event_id", "t_ms")
    return ops.decayed_history(ops.with_decay_rates(rows, BETAS), ["session_id", "event_type"], "beta")


def _loglik(spark, folder):
    end_ms = _end_ms(spark, folder)
    return ops.hawkes_loglik(_history(spark, folder), ["event_type", "beta"], F.lit(MU), F.lit(ALPHA), end_ms, _exposure(end_ms))


@query("hawkes_history", f"WITH {SIGNAL_SQL}, {_HAWKES_SQL} SELECT session_id, event_type, event_id, CAST(beta AS DOUBLE) AS beta, round(h, 6) AS history FROM pr")
def hawkes_history(spark, folder):
    return _history(spark, folder).select("session_id", "event_type", "event_id", "beta", F.round("history", 6).alias("history"))


@query("hawkes_loglik_grid", f"WITH {SIGNAL_SQL}, {_HAWKES_SQL} SELECT event_type, CAST(beta AS DOUBLE) AS beta, n, CAST({MU} AS DOUBLE) AS mu, CAST({ALPHA} AS DOUBLE) AS alpha, round(CAST(loglik AS DOUBLE), 4) AS loglik FROM hl")
def hawkes_loglik_grid(spark, folder):
    return _loglik(spark, folder).withColumn("loglik", F.round("loglik", 4))


@query("model_comparison", f"""
WITH {SIGNAL_SQL}, {_POISSON_SQL}, {_HAWKES_SQL}, b AS (SELECT event_type, max(loglik) AS ll FROM hl GROUP BY ALL),
d AS (SELECT event_type, 2 - 2 * loglik AS paic, 6 - 2 * ll AS haic FROM pf JOIN b USING (event_type))
SELECT event_type, round(CAST(paic - haic AS DOUBLE), 4) AS delta_aic, CASE WHEN haic < paic THEN 'Hawkes' ELSE 'Poisson' END AS winner, CASE WHEN paic - haic > 10 THEN 'strong_self_excitation' WHEN paic - haic > 2 THEN 'moderate_self_excitation' ELSE 'weak_or_none' END AS evidence FROM d""")
def model_comparison(spark, folder):
    poisson = ops.poisson_fit(signals(spark, folder), ["event_type"], _exposure(_end_ms(spark, folder))).select("event_type", "aic")
    hawkes = _loglik(spark, folder).groupBy("event_type").agg((6 - 2 * F.max("loglik")).alias("haic"))
    delta = F.col("aic") - F.col("haic")
    return poisson.join(hawkes, "event_type").select("event_type", F.round(delta, 4).alias("delta_aic"), F.when(delta > 0, "Hawkes").otherwise("Poisson").alias("winner"),
                                                     ops.model_choice(delta).alias("evidence"))


@query("intensity_grid", f"""
WITH {SIGNAL_SQL}, g AS (SELECT session_id, unnest(range(n + 1)) * {GRID_MS} AS t_ms FROM (SELECT session_id, max(t_ms) // {GRID_MS} + 1 AS n FROM sig GROUP BY session_id))
SELECT g.session_id, g.t_ms, round({MU} + {ALPHA} * 0.5 * coalesce(sum(exp(-0.5 * (g.t_ms - e.t_ms) / 1000.0)), 0), 6) AS intensity FROM g LEFT JOIN sig e ON e.session_id = g.session_id AND e.t_ms < g.t_ms GROUP BY ALL""")
def intensity_grid(spark, folder):
    """Intensity on a time grid; an event counts only strictly after it happened, so probes come first at equal times."""
    rows = signals(spark, folder)
    events = rows.select("session_id", "t_ms", (F.col("event_id") + 1).alias("event_id"), F.lit(1.0).alias("w"))
    ends = observed_durations(rows, GRID_MS)
    probes = ends.select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms"), F.lit(GRID_MS).cast("long"))).alias("t_ms"),
                         F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("w"))
    both = events.unionByName(probes).withColumn("beta", F.least(F.lit(0.5), F.lit(100.0)))
    d = ops.decayed_history(both, ["session_id"], "beta", weights={"history": F.col("w")}).filter("event_id = -1")
    return d.select("session_id", "t_ms", F.round(MU + ALPHA * F.col("beta") * F.col("history"), 6).alias("intensity"))


@query("hawkes_fit")
def hawkes_fit(spark, folder):
    return ops.fit_hawkes(signals(spark, folder), "event_type", "session_id", end_ms=_end_ms(spark, folder))


@query("hawkes_multivariate")
def hawkes_multivariate(spark, folder):
    return ops.fit_multivariate(signals(spark, folder), "event_type", "session_id", KINDS, end_ms=_end_ms(spark, folder))
