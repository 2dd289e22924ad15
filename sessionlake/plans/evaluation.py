"""Calibration, precision gates and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.functions.scalars import first_max_name, safe_rate, token_count, wilson_lower
from sessionlake.operators import binning, counters as counter_ops, evaluation as ops
from sessionlake.operators.ordering import time_order
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import SIGNAL_SQL, signals, table

_PAIR_SQL = """
pairs AS (SELECT doc_id, quality, toxic, (doc_id * 37 % 100) / 100.0 AS score FROM labels)"""


def pairs(spark, folder):
    return table(spark, folder, "labels").select("doc_id", "quality", "toxic", (F.col("doc_id") * 37 % 100 / 100.0).alias("score"))


_CNT = """count(*) AS reference_events, count(*) FILTER (t) AS actual_positive, count(*) FILTER (p) AS predicted_positive, count(*) FILTER (t AND p) AS true_positive,
  count(*) FILTER (NOT t AND p) AS false_positive, count(*) FILTER (t AND NOT p) AS false_negative"""


def _rates(source: str, extra: str = "*") -> str:
    return f"""SELECT {extra}, round(CASE WHEN predicted_positive > 0 THEN true_positive / predicted_positive ELSE 0 END, 4) AS precision,
  round(CASE WHEN predicted_positive > 0 THEN (true_positive / predicted_positive + 1.96 * 1.96 / (2 * predicted_positive) - 1.96 * sqrt(true_positive / predicted_positive * (1 - true_positive / predicted_positive) / predicted_positive + 1.96 * 1.96 / (4 * predicted_positive * predicted_positive))) / (1 + 1.96 * 1.96 / predicted_positive) ELSE 0 END, 4) AS precision_lower,
  round(CASE WHEN actual_positive > 0 THEN true_positive / actual_positive ELSE 0 END, 4) AS recall FROM {source}"""


_EVENT_SQL = """
xe AS (SELECT session_id, event_id, t_ms, t_ms / 1000.0 AS time_s, value, k, event_type, CASE WHEN t_ms < 210000 THEN 'calibration' WHEN t_ms < 300000 THEN 'validation' ELSE 'deployment' END AS split,
  CASE WHEN k % 10 < 6 THEN 'blue' WHEN k % 10 < 9 THEN 'green' ELSE 'red' END AS color, 1 + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END AS total, CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS unresolved, event_id % 4 AS tracks,
  k >= 95 AS saturated, event_id % 6 <> 0 AS bar_a, event_id % 7 <> 0 AS bar_b, event_id % 5 <> 0 AS level_ok, (50 + k % 50) / 100.0 AS confidence, 'visual_trajectory' AS evidence,
  CASE WHEN k % 11 = 0 THEN 'green' ELSE CASE WHEN k % 10 < 6 THEN 'blue' WHEN k % 10 < 9 THEN 'green' ELSE 'red' END END AS candidate, (60 + event_id % 40) / 100.0 AS score FROM sig),
ref AS (SELECT *, CASE WHEN NOT saturated AND total >= 1 AND unresolved = 0 AND tracks = total AND bar_a AND bar_b THEN total END AS strict_count,
  CASE WHEN NOT saturated AND unresolved = 0 AND total = 1 AND tracks = 1 AND bar_a AND bar_b AND level_ok AND confidence >= 0.75 THEN color END AS strict_color FROM xe)"""


def pickups(spark, folder):
    k, e = F.col("k"), F.col("event_id")
    colour = F.when(k % 10 < 6, "blue").when(k % 10 < 9, "green").otherwise("red")
    d = signals(spark, folder).select(
        "session_id", "event_id", "t_ms", (F.col("t_ms") / 1000.0).alias("time_s"), "value", "k", "event_type", colour.alias("color"),
        (1 + F.when(k % 8 == 0, 1).otherwise(0)).cast("long").alias("total"), F.when(k % 9 == 0, 1).otherwise(0).alias("unresolved"), (e % 4).alias("tracks"), (k >= 95).alias("saturated"),
        (e % 6 != 0).alias("bar_a"), (e % 7 != 0).alias("bar_b"), (e % 5 != 0).alias("level_ok"), ((50 + k % 50) / 100.0).alias("confidence"),
        F.when(k % 11 == 0, "green").otherwise(colour).alias("candidate"), ((60 + e % 40) / 100.0).alias("score"))
    c = F.col
    steady = ~c("saturated") & (c("unresolved") == 0) & c("bar_a") & c("bar_b")
    return d.withColumns({
        "split": ops.split_label(c("time_s")),
        "strict_count": F.when(steady & (c("total") >= 1) & (c("tracks") == c("total")), c("total")),
        "strict_color": F.when(steady & (c("total") == 1) & (c("tracks") == 1) & c("level_ok") & (c("confidence") >= 0.75), c("color"))})


@query("strict_labels", f"WITH {SIGNAL_SQL}, {_EVENT_SQL} SELECT event_id, split, strict_count, strict_color FROM ref")
def strict_labels(spark, folder):
    """Reference labels only from clear, fully observed pickups."""
    return pickups(spark, folder).select("event_id", "split", "strict_count", "strict_color")


@query("metric_by_split", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, b AS (SELECT split, strict_count = 1 AS t, tracks = 1 AND score >= 0.75 AS p FROM ref WHERE strict_count IS NOT NULL), c AS (SELECT split, {_CNT} FROM b GROUP BY split)
{_rates('c')}""")
def metric_by_split(spark, folder):
    rows = pickups(spark, folder).filter("strict_count IS NOT NULL")
    truth, predicted = F.col("strict_count") == 1, (F.col("tracks") == 1) & (F.col("score") >= 0.75)
    return ops.with_rates(rows.groupBy("split").agg(*ops.metric_columns(truth, predicted)))


_GRID_SQL = f"""
g AS (SELECT v, round(v / 100, 2) AS threshold, strict_count = 1 AS t, tracks IN (1, 2) AND round(score * 100, 6) >= v AS p FROM ref, range(60, 97) AS r(v) WHERE strict_count IS NOT NULL AND split = 'calibration'),
gc AS (SELECT threshold, {_CNT} FROM g GROUP BY ALL), gt AS ({_rates('gc')})"""


def _grid(spark, folder):
    rows = pickups(spark, folder).filter("strict_count IS NOT NULL AND split = 'calibration'")
    return ops.threshold_table(rows, F.col("strict_count") == 1, F.when(F.col("tracks").isin(1, 2), F.col("score")))


@query("threshold_grid", f"WITH {SIGNAL_SQL}, {_EVENT_SQL}, {_GRID_SQL} SELECT * FROM gt")
def threshold_grid(spark, folder):
    return _grid(spark, folder)


@query("threshold_search", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, {_GRID_SQL}, r AS (SELECT *, predicted_positive >= 20 AND precision >= 0.95 AS ok FROM gt)
SELECT * EXCLUDE (ok) FROM r ORDER BY ok DESC, CASE WHEN ok THEN predicted_positive ELSE precision END DESC, CASE WHEN ok THEN 0 ELSE predicted_positive END DESC, threshold LIMIT 1""")
def threshold_search(spark, folder):
    return ops.chosen_threshold(_grid(spark, folder))


@query("wilson_bounds", f"""
WITH {SIGNAL_SQL}, a AS (SELECT session_id, count(*) AS n, count(*) FILTER (k < 50) AS s FROM sig GROUP BY ALL)
SELECT session_id, round((s / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(s / n * (1 - s / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS lower FROM a""")
def wilson_bounds(spark, folder):
    a = signals(spark, folder).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") < 50).alias("s"))
    return a.select("session_id", F.round(wilson_lower(F.col("s"), F.col("n")), 6).alias("lower"))


_RATIO_SQL = """
ra AS (SELECT split, 0.3 + value / 100 AS gain FROM ref WHERE strict_color = 'blue'),
rb AS (SELECT split, round(gain / CASE WHEN gain < 1.5 THEN 1.0 ELSE 2.0 END, 4) AS ratio FROM ra WHERE gain / CASE WHEN gain < 1.5 THEN 1.0 ELSE 2.0 END BETWEEN 0.65 AND 1.40),
rm AS (SELECT split, count(*) AS n, CASE WHEN count(*) >= 10 THEN quantile_cont(ratio, 0.5) ELSE 1.0 END AS factor FROM rb GROUP BY split)"""


def _ratios(spark, folder):
    gain = 0.3 + F.col("value") / 100
    ratio = gain / F.when(gain < 1.5, 1.0).otherwise(2.0)
    return pickups(spark, folder).filter("strict_color = 'blue'").withColumn("ratio", ratio).filter(F.col("ratio").between(0.65, 1.40)).select(
        "split", F.round("ratio", 4).alias("ratio"))


@query("growth_correction", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, {_RATIO_SQL}
SELECT split, n AS samples, round(factor, 6) AS factor, round(quantile_cont(round(abs(ratio - factor), 6), 0.5), 6) AS mad FROM rb JOIN rm USING (split) GROUP BY split, n, factor""")
def growth_correction(spark, folder):
    """Median of isolated ratios and their median absolute deviation, per split."""
    rows = _ratios(spark, folder)
    centre = binning.group_quantiles(rows, ["split"], "ratio", {"med": 0.5}).join(rows.groupBy("split").agg(F.count(F.lit(1)).alias("samples")), "split")
    centre = centre.withColumn("factor", F.when(F.col("samples") >= 10, F.col("med")).otherwise(1.0))
    gaps = rows.join(F.broadcast(centre), "split").select("split", F.round(F.abs(F.col("ratio") - F.col("factor")), 6).alias("gap"))
    mad = binning.group_quantiles(gaps, ["split"], "gap", {"mad": 0.5}, scale=1_000_000)
    return centre.join(mad, "split").select("split", "samples", F.round("factor", 6).alias("factor"), F.round("mad", 6).alias("mad"))


@query("rolling_growth")
def rolling_growth(spark, folder):
    rows = pickups(spark, folder).select("session_id", "t_ms", "event_id", "split", (0.3 + F.col("value") / 100).alias("gain"), (F.col("strict_color") == "blue").alias("reference"))
    return ops.rolling_growth(rows, time_order(rows), minimum=3)


_GATE_SQL = f"""
gb AS (SELECT split, c AS color, strict_count = 1 AND color = c AS t, candidate = c AND tracks >= 1 AND score >= 0.65 AND NOT saturated AS p FROM ref, (VALUES ('blue'), ('green'), ('red')) v(c) WHERE strict_count IS NOT NULL),
gc AS (SELECT color, split, {_CNT} FROM gb GROUP BY ALL), gm AS ({_rates('gc')}),
ga AS (SELECT color, bool_and(predicted_positive >= 20 AND precision >= 0.60) FILTER (split IN ('calibration', 'validation')) AS enabled, bool_and(predicted_positive >= 20 AND precision >= 0.60) AS audited FROM gm GROUP BY color)"""


def _gates(spark, folder):
    rows = pickups(spark, folder).filter("strict_count IS NOT NULL")
    # one row per colour and split, not one per event and colour
    guess = (F.col("tracks") >= 1) & (F.col("score") >= 0.65) & ~F.col("saturated")
    cells = rows.groupBy("split", "color", F.when(guess, F.col("candidate")).alias("guess"), (F.col("strict_count") == 1).alias("single")).agg(F.count(F.lit(1)).alias("n"))
    colours = F.explode(F.array(*[F.lit(c) for c in ops.COLOURS])).alias("c")
    d = cells.select("*", colours).withColumns({"t": F.col("single") & (F.col("color") == F.col("c")), "p": F.coalesce(F.col("guess") == F.col("c"), F.lit(False))})
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    counts = d.groupBy(F.col("c").alias("color"), "split").agg(
        F.sum("n").alias("reference_events"), total(F.col("t")).alias("actual_positive"), total(F.col("p")).alias("predicted_positive"), total(F.col("t") & F.col("p")).alias("true_positive"),
        total(~F.col("t") & F.col("p")).alias("false_positive"), total(F.col("t") & ~F.col("p")).alias("false_negative"))
    return ops.with_rates(counts)


@query("colour_metrics", f"WITH {SIGNAL_SQL}, {_EVENT_SQL}, {_GATE_SQL} SELECT * FROM gm")
def colour_metrics(spark, folder):
    return _gates(spark, folder)


def _gate_flags(metrics, target=0.60):
    ok = ops.gate_passes(F.col("predicted_positive"), F.col("precision"), target=target)
    return metrics.groupBy("color").agg(F.bool_and(F.when(F.col("split") != "deployment", ok)).alias("enabled"), F.bool_and(ok).alias("audited"))


@query("precision_gates", f"WITH {SIGNAL_SQL}, {_EVENT_SQL}, {_GATE_SQL} SELECT * FROM ga")
def precision_gates(spark, folder):
    """A colour is enabled by held-out precision, and audited on deployment too."""
    return _gate_flags(_gates(spark, folder))


@query("gated_reassignment", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, {_GATE_SQL}
SELECT event_id, unresolved AS baseline_unresolved, CASE WHEN unresolved = 0 THEN 'baseline_already_classified'
  WHEN NOT (tracks = 1 AND score >= 0.65 AND NOT saturated AND level_ok) THEN concat_ws('|', CASE WHEN tracks <> 1 THEN 'pickup_count_not_exactly_one' WHEN score < 0.65 THEN 'pickup_count_score_below_gate' END,
    CASE WHEN saturated THEN 'xp_bar_saturated' END, CASE WHEN NOT level_ok THEN 'hud_level_not_directly_confirmed' END)
  WHEN NOT enabled THEN 'heldout_precision_or_support_gate_failed' WHEN split = 'deployment' AND NOT audited THEN 'deployment_precision_or_support_gate_failed' ELSE 'passed_heldout_precision_gate' END AS reason,
  unresolved = 1 AND tracks = 1 AND score >= 0.65 AND NOT saturated AND level_ok AND enabled AND (split <> 'deployment' OR audited) AS applied
FROM ref JOIN ga ON ga.color = ref.candidate""")
def gated_reassignment(spark, folder):
    c = F.col
    rows = pickups(spark, folder).join(F.broadcast(_gate_flags(_gates(spark, folder)).withColumnRenamed("color", "candidate")), "candidate")
    eligible = (c("tracks") == 1) & (c("score") >= 0.65) & ~c("saturated") & c("level_ok")
    why = F.concat_ws("|", F.when(c("tracks") != 1, "pickup_count_not_exactly_one").when(c("score") < 0.65, "pickup_count_score_below_gate"),
                      F.when(c("saturated"), "xp_bar_saturated"), F.when(~c("level_ok"), "hud_level_not_directly_confirmed"))
    late = (c("split") == "deployment") & ~c("audited")
    reason = (F.when(c("unresolved") == 0, "baseline_already_classified").when(~eligible, why).when(~c("enabled"), "heldout_precision_or_support_gate_failed")
              .when(late, "deployment_precision_or_support_gate_failed").otherwise("passed_heldout_precision_gate"))
    return rows.select("event_id", c("unresolved").alias("baseline_unresolved"), reason.alias("reason"), ((c("unresolved") == 1) & eligible & c("enabled") & ~late).alias("applied"))


@query("entry_assist_validation", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, m AS (SELECT split, color, candidate, strict_color IS NOT NULL AS known, strict_color = candidate AS ok FROM ref WHERE tracks >= 1 AND NOT saturated),
a AS (SELECT split, candidate AS color, count(*) AS predictions, count(*) FILTER (known) AS checked, count(*) FILTER (ok) AS correct FROM m GROUP BY ALL)
SELECT *, round(CASE WHEN checked > 0 THEN correct / checked ELSE 0 END, 4) AS precision, checked >= 20 AND CASE WHEN checked > 0 THEN correct / checked ELSE 0 END >= 0.95 AS passed FROM a""")
def entry_assist_validation(spark, folder):
    """Predicted colour of entering pickups against the strict labels, with the support and precision gate."""
    rows = pickups(spark, folder).filter("tracks >= 1 AND NOT saturated")
    a = rows.groupBy("split", F.col("candidate").alias("color")).agg(
        F.count(F.lit(1)).alias("predictions"), F.count("strict_color").alias("checked"), F.count_if(F.col("strict_color") == F.col("candidate")).alias("correct"))
    rate = safe_rate(F.col("correct"), F.col("checked"))
    return a.select("*", F.round(rate, 4).alias("precision"), ((F.col("checked") >= 20) & (rate >= 0.95)).alias("passed"))


@query("confusion", f"WITH {_PAIR_SQL} SELECT quality, toxic, count(*) AS n FROM pairs GROUP BY ALL")
def confusion(spark, folder):
    return ops.confusion(pairs(spark, folder), "quality", "toxic")


_CLASS_SQL = f"""
cf AS (SELECT color AS t, CASE WHEN event_id % 10 < 7 THEN candidate WHEN event_id % 10 = 7 THEN 'red' WHEN event_id % 10 = 8 THEN 'blue' ELSE '' END AS p FROM ref),
cl AS (SELECT c AS label, count(*) FILTER (t = c) AS support, count(*) FILTER (p = c) AS predicted, count(*) FILTER (t = c AND p = c) AS tp FROM cf, (VALUES ('blue'), ('green'), ('red')) v(c) WHERE p <> '' GROUP BY c),
cr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM cl)"""


def _predictions(spark, folder):
    e = F.col("event_id") % 10
    return pickups(spark, folder).select(F.col("color").alias("t"), F.when(e < 7, F.col("candidate")).when(e == 7, "red").when(e == 8, "blue").otherwise("").alias("p"), "candidate")


@query("class_report", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, {_CLASS_SQL} SELECT label, support, predicted, tp, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM cr""")
def class_report(spark, folder):
    cells = ops.confusion(_predictions(spark, folder).filter("p <> ''"), "t", "p")
    return ops.class_report(cells, "t", "p", ops.COLOURS).drop("rows").withColumns({name: F.round(name, 6) for name in ("precision", "recall", "f1")})


@query("overall_report", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, {_CLASS_SQL}, n AS (SELECT count(*) AS n FROM cf)
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(re) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS assigned,
  round(sum(support) / any_value(n), 6) AS coverage FROM cr, n""")
def overall_report(spark, folder):
    cells = ops.confusion(_predictions(spark, folder), "t", "p")
    report = ops.class_report(cells, "t", "p", ops.COLOURS)
    return ops.overall_report(report).withColumns({name: F.round(name, 6) for name in ("accuracy", "balanced_accuracy", "macro_f1", "coverage")})


_COUNT_SQL = """
hm AS (SELECT session_id, t_ms // 60000 AS w, CAST(sum(k % 4) AS BIGINT) AS blue, CAST(sum(k % 3) AS BIGINT) AS green, CAST(sum(CASE WHEN k >= 97 THEN 1 ELSE 0 END) AS BIGINT) AS red,
  CAST(sum(k % 4 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pblue, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE k % 3 END) AS BIGINT) AS pgreen, CAST(sum(CASE WHEN k >= 98 THEN 1 ELSE 0 END) AS BIGINT) AS pred FROM sig GROUP BY ALL)"""


def interval_counts(spark, folder):
    k, e = F.col("k"), F.col("event_id")
    total = lambda col: F.sum(col).cast("long")
    return signals(spark, folder).groupBy("session_id", F.expr("t_ms div 60000").alias("w")).agg(
        total(k % 4).alias("blue"), total(k % 3).alias("green"), total(F.when(k >= 97, 1).otherwise(0)).alias("red"),
        total(k % 4 + F.when(e % 5 == 0, 1).otherwise(0)).alias("pblue"), total(F.when(e % 7 != 0, k % 3).otherwise(0)).alias("pgreen"), total(F.when(k >= 98, 1).otherwise(0)).alias("pred"))


@query("count_errors", f"""
WITH {SIGNAL_SQL}, {_COUNT_SQL}, u AS (SELECT 'blue' AS color, blue AS a, pblue AS p FROM hm UNION ALL SELECT 'green', green, pgreen FROM hm UNION ALL SELECT 'red', red, pred FROM hm)
SELECT color, count(*) AS matched, round(sqrt(avg((p - a) * (p - a))), 6) AS rmse, round(avg(abs(p - a)), 6) AS mae, round(avg(p - a), 6) AS bias, CAST(max(abs(p - a)) AS DOUBLE) AS max_error, round(avg(CASE WHEN p = a THEN 1.0 ELSE 0 END), 6) AS exact,
  round(avg(CASE WHEN abs(p - a) <= 1 THEN 1.0 ELSE 0 END), 6) AS within_1, round(avg(CASE WHEN abs(p - a) <= 5 THEN 1.0 ELSE 0 END), 6) AS within_5, CAST(sum(a) AS BIGINT) AS actual_total, CAST(sum(p) AS BIGINT) AS predicted_total, round(corr(a, p), 6) AS correlation FROM u GROUP BY color""")
def count_errors(spark, folder):
    """Count errors per colour over matched intervals."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("color"), F.col(c).alias("a"), F.col(f"p{c}" if c != "red" else "pred").alias("p")) for c in ops.COLOURS])).alias("x")
    rows = interval_counts(spark, folder).select(long).select("x.*")
    d = rows.groupBy("color").agg(*ops.error_metrics(F.col("a"), F.col("p")), F.sum("a").alias("actual_total"), F.sum("p").alias("predicted_total"),
                                  F.corr(F.col("a").cast("double"), F.col("p").cast("double")).alias("correlation"))
    return d.withColumns({name: F.round(name, 6) for name in ("rmse", "mae", "bias", "exact", "within_1", "within_5", "correlation")})


@query("overall_count_errors", f"""
WITH {SIGNAL_SQL}, {_COUNT_SQL}, u AS (SELECT 'blue' AS color, blue AS a, pblue AS p FROM hm UNION ALL SELECT 'green', green, pgreen FROM hm UNION ALL SELECT 'red', red, pred FROM hm),
c AS (SELECT color, avg(abs(p - a)) AS mae, sqrt(avg((p - a) * (p - a))) AS rmse, sum(a) AS t, sum(abs(p - a)) AS e, sum((p - a) * (p - a)) AS s, count(*) AS n FROM u GROUP BY color)
SELECT round(avg(mae), 6) AS macro_mae, round(avg(rmse), 6) AS macro_rmse, round(sum(e) / sum(t), 6) AS weighted_mae_per_item, round(sqrt(sum(s) / sum(n)), 6) AS pooled_rmse FROM c""")
def overall_count_errors(spark, folder):
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("color"), F.col(c).alias("a"), F.col(f"p{c}" if c != "red" else "pred").alias("p")) for c in ops.COLOURS])).alias("x")
    rows = interval_counts(spark, folder).select(long).select("x.*")
    gap = F.abs(F.col("p") - F.col("a")).cast("double")
    c = rows.groupBy("color").agg(F.avg(gap).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.sum("a").alias("t"), F.sum(gap).alias("e"), F.sum(gap * gap).alias("s"), F.count(F.lit(1)).alias("n"))
    return c.agg(F.round(F.avg("mae"), 6).alias("macro_mae"), F.round(F.avg("rmse"), 6).alias("macro_rmse"), F.round(F.sum("e") / F.sum("t"), 6).alias("weighted_mae_per_item"),
                 F.round(F.sqrt(F.sum("s") / F.sum("n")), 6).alias("pooled_rmse"))


@query("composition_error", f"""
WITH {SIGNAL_SQL}, {_COUNT_SQL}
SELECT session_id, w, round(CASE WHEN blue + green + red = 0 THEN CASE WHEN pblue + pgreen + pred = 0 THEN 0 ELSE 1 END ELSE (abs(blue - pblue) + abs(green - pgreen) + abs(red - pred)) / (blue + green + red) END, 6) AS error FROM hm""")
def composition_error(spark, folder):
    """Summed colour error relative to the true count; an empty interval is right only when predicted empty."""
    c = F.col
    true, guess = c("blue") + c("green") + c("red"), c("pblue") + c("pgreen") + c("pred")
    off = F.abs(c("blue") - c("pblue")) + F.abs(c("green") - c("pgreen")) + F.abs(c("red") - c("pred"))
    return interval_counts(spark, folder).select("session_id", "w", F.round(F.when(true == 0, F.when(guess == 0, 0.0).otherwise(1.0)).otherwise(off / true), 6).alias("error"))


@query("presence_matrix", f"""
WITH {SIGNAL_SQL}, {_COUNT_SQL}, u AS (SELECT 'blue' AS color, blue > 0 AS a, pblue > 0 AS p FROM hm UNION ALL SELECT 'green', green > 0, pgreen > 0 FROM hm UNION ALL SELECT 'red', red > 0, pred > 0 FROM hm)
SELECT color, count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn, round(avg(CASE WHEN a = p THEN 1.0 ELSE 0 END), 6) AS accuracy FROM u GROUP BY color""")
def presence_matrix(spark, folder):
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("color"), (F.col(c) > 0).alias("a"), (F.col(f"p{c}" if c != "red" else "pred") > 0).alias("p")) for c in ops.COLOURS])).alias("x")
    a, p = F.col("a"), F.col("p")
    return interval_counts(spark, folder).select(long).select("x.*").groupBy("color").agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"), F.round(F.avg(F.when(a == p, 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("count_bin_matrix", f"""
WITH {SIGNAL_SQL}, {_COUNT_SQL}, b AS (SELECT CASE WHEN blue = 0 THEN '0' WHEN blue <= 5 THEN '1-5' WHEN blue <= 10 THEN '6-10' ELSE '11+' END AS a, CASE WHEN pblue = 0 THEN '0' WHEN pblue <= 5 THEN '1-5' WHEN pblue <= 10 THEN '6-10' ELSE '11+' END AS p FROM hm)
SELECT a AS actual_bin, count(*) FILTER (p = '0') AS p0, count(*) FILTER (p = '1-5') AS p1, count(*) FILTER (p = '6-10') AS p6, count(*) FILTER (p = '11+') AS p11 FROM b GROUP BY a""")
def count_bin_matrix(spark, folder):
    cell = lambda col: F.when(col == 0, "0").when(col <= 5, "1-5").when(col <= 10, "6-10").otherwise("11+")
    d = interval_counts(spark, folder).select(cell(F.col("blue")).alias("actual_bin"), cell(F.col("pblue")).alias("p"))
    return d.groupBy("actual_bin").pivot("p", ["0", "1-5", "6-10", "11+"]).count().na.fill(0).toDF("actual_bin", "p0", "p1", "p6", "p11")


@query("dominant_matrix", f"""
WITH {SIGNAL_SQL}, {_COUNT_SQL}, d AS (SELECT CASE WHEN blue >= green AND blue >= red THEN 'blue' WHEN green >= red THEN 'green' ELSE 'red' END AS actual, CASE WHEN pblue >= pgreen AND pblue >= pred THEN 'blue' WHEN pgreen >= pred THEN 'green' ELSE 'red' END AS predicted FROM hm WHERE blue + green + red > 0)
SELECT actual, predicted, count(*) AS n FROM d GROUP BY ALL""")
def dominant_matrix(spark, folder):
    c = F.col
    rows = interval_counts(spark, folder).filter("blue + green + red > 0")
    return rows.groupBy(first_max_name(ops.COLOURS, [c("blue"), c("green"), c("red")]).alias("actual"),
                        first_max_name(ops.COLOURS, [c("pblue"), c("pgreen"), c("pred")]).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


_RATER_SQL = """
hu AS (SELECT c_custkey AS id, ' ' || c_custkey || ' - ' || (c_custkey + 5) AS stamp, round(c_acctbal) AS y FROM customer),
mc AS (SELECT c_custkey AS id, c_custkey || '-' || (c_custkey + 5) AS stamp, round(c_acctbal) + c_custkey % 7 - 3 AS yhat FROM customer WHERE c_custkey % 11 <> 0),
cm AS (SELECT h.id, y, yhat, yhat - y AS err FROM hu h JOIN mc m ON regexp_replace(h.stamp, '\\s+', '', 'g') = m.stamp)"""


def _raters(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal").alias("y"))
    human = customers.withColumn("stamp", F.regexp_replace(F.concat(F.lit(" "), "id", F.lit(" - "), F.col("id") + 5), r"\s+", ""))
    machine = customers.filter("id % 11 <> 0").select(F.concat("id", F.lit("-"), F.col("id") + 5).alias("stamp"), (F.col("y") + F.col("id") % 7 - 3).alias("yhat"))
    return human.join(machine, "stamp")


@query("rater_comparison", f"""
WITH {_RATER_SQL} SELECT count(*) AS matched, round(sqrt(avg(err * err)), 6) AS rmse, round(avg(abs(err)), 6) AS mae, round(avg(err), 6) AS bias, max(abs(err)) AS max_error, round(avg(CASE WHEN err = 0 THEN 1.0 ELSE 0 END), 6) AS exact,
  round(avg(CASE WHEN abs(err) <= 1 THEN 1.0 ELSE 0 END), 6) AS within_1, round(avg(CASE WHEN abs(err) <= 5 THEN 1.0 ELSE 0 END), 6) AS within_5 FROM cm""")
def rater_comparison(spark, folder):
    """Human counts against machine counts, matched on the interval label."""
    return _raters(spark, folder).agg(*ops.error_metrics(F.col("y"), F.col("yhat"))).withColumns(
        {name: F.round(name, 6) for name in ("rmse", "mae", "bias", "exact", "within_1", "within_5")})


@query("worst_intervals", f"WITH {_RATER_SQL} SELECT id, y, yhat, err AS error, abs(err) AS absolute_error FROM cm ORDER BY abs(err) DESC, id LIMIT 10")
def worst_intervals(spark, folder):
    """The ten intervals with the largest error."""
    d = _raters(spark, folder).select("id", "y", "yhat", (F.col("yhat") - F.col("y")).alias("error"))
    return d.withColumn("absolute_error", F.abs("error")).orderBy(F.desc("absolute_error"), "id").limit(10)


@query("duplicate_labels", f"WITH {_PAIR_SQL} SELECT quality * 2 + toxic AS label, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) > 1")
def duplicate_labels(spark, folder):
    """Join keys that would not be one to one."""
    return pairs(spark, folder).groupBy((F.col("quality") * 2 + F.col("toxic")).alias("label")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("status_ladder", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL} SELECT event_id, CASE WHEN strict_color IS NOT NULL THEN 'observed_reference' WHEN saturated THEN 'excluded_saturated' WHEN score >= 0.9 AND tracks = 1 THEN 'exact_model_assignment'
  WHEN score >= 0.75 THEN 'likely_color_only' ELSE 'unresolved' END AS status FROM ref""")
def status_ladder(spark, folder):
    c = F.col
    status = (F.when(c("strict_color").isNotNull(), "observed_reference").when(c("saturated"), "excluded_saturated").when((c("score") >= 0.9) & (c("tracks") == 1), "exact_model_assignment")
              .when(c("score") >= 0.75, "likely_color_only").otherwise("unresolved"))
    return pickups(spark, folder).select("event_id", status.alias("status"))


_LIKELY_SQL = """
sv AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN 'blue|green' WHEN k % 4 = 2 THEN 'red|blue|red' ELSE 'green' END AS colors, CASE WHEN k % 4 = 1 THEN '0.9|0.8' WHEN k % 4 = 2 THEN '0.7|0.95' WHEN k % 4 = 3 THEN 'nan' ELSE '' END AS scores,
   k % 3 AS ub, event_id % 2 AS ug, 0 AS ur FROM sig),
se2 AS (SELECT *, list_filter(string_split(colors, '|'), lambda x: x IN ('blue', 'green', 'red')) AS cs, list_filter(string_split(scores, '|'), lambda x: x <> '' AND lower(x) <> 'nan') AS ss FROM sv),
vo AS (SELECT *, list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN i <= len(ss) THEN CAST(ss[i] AS DOUBLE) ELSE 1.0 END) AS w FROM se2),
vt AS (SELECT *, coalesce(list_sum(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN cs[i] = 'blue' THEN w[i] ELSE 0 END)), 0) AS vb, coalesce(list_sum(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN cs[i] = 'green' THEN w[i] ELSE 0 END)), 0) AS vg,
   coalesce(list_sum(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN cs[i] = 'red' THEN w[i] ELSE 0 END)), 0) AS vr FROM vo),
vf AS (SELECT event_id, vb + vg + vr > 0 AS traj, CASE WHEN vb + vg + vr > 0 THEN vb ELSE ub END AS b, CASE WHEN vb + vg + vr > 0 THEN vg ELSE ug END AS g, CASE WHEN vb + vg + vr > 0 THEN vr ELSE ur END AS r FROM vt)"""


@query("saturated_likely_color", f"""
WITH {SIGNAL_SQL}, {_LIKELY_SQL} SELECT event_id, CASE WHEN b + g + r <= 0 THEN 'blue' WHEN b >= g AND b >= r THEN 'blue' WHEN g >= r THEN 'green' ELSE 'red' END AS color, round(CASE WHEN b + g + r <= 0 THEN 0 ELSE greatest(b, g, r) / (b + g + r) END, 6) AS confidence,
  CASE WHEN traj THEN 'trajectory_score_vote' WHEN b + g + r > 0 THEN 'unmatched_candidate_vote' ELSE 'weak_visual_fallback' END AS reason FROM vf""")
def saturated_likely_color(spark, folder):
    """Likely colour of a saturated pickup: trajectory scores vote, else unmatched candidates, else the weakest fallback."""
    k = F.col("k") % 4
    rows = signals(spark, folder).select(
        "event_id", F.when(k == 0, "").when(k == 1, "blue|green").when(k == 2, "red|blue|red").otherwise("green").alias("colors"),
        F.when(k == 1, "0.9|0.8").when(k == 2, "0.7|0.95").when(k == 3, "nan").otherwise("").alias("scores"), (F.col("k") % 3).alias("ub"), (F.col("event_id") % 2).alias("ug"), F.lit(0).cast("long").alias("ur"))
    colours = F.filter(F.split("colors", "\\|"), lambda c: c.isin(*ops.COLOURS))
    scores = F.transform(F.filter(F.split("scores", "\\|"), lambda s: (s != "") & (F.lower(s) != "nan")), lambda s: F.coalesce(s.try_cast("double"), F.lit(0.0)))
    d = rows.withColumns({"cs": colours, "ss": scores})
    votes = F.transform("cs", lambda c, i: F.struct(c.alias("c"), F.coalesce(F.get("ss", i), F.lit(1.0)).alias("w")))
    d = d.withColumn("votes", votes)
    total = lambda colour: F.aggregate("votes", F.lit(0.0), lambda acc, v: acc + F.when(v["c"] == colour, v["w"]).otherwise(0.0))
    d = d.withColumns({f"v_{c}": total(c) for c in ops.COLOURS})
    traced = F.col("v_blue") + F.col("v_green") + F.col("v_red") > 0
    d = d.withColumns({"traced": traced})
    fallback = {"blue": "ub", "green": "ug", "red": "ur"}
    d = d.withColumns({f"w_{c}": F.when(F.col("traced"), F.col(f"v_{c}")).otherwise(F.col(fallback[c]).cast("double")) for c in ops.COLOURS})
    weights = [F.col(f"w_{c}") for c in ops.COLOURS]
    whole = weights[0] + weights[1] + weights[2]
    return d.select("event_id", F.when(whole <= 0, "blue").otherwise(first_max_name(ops.COLOURS, weights)).alias("color"),
                    F.round(F.when(whole <= 0, 0.0).otherwise(F.greatest(*weights) / whole), 6).alias("confidence"),
                    F.when(F.col("traced"), "trajectory_score_vote").when(whole > 0, "unmatched_candidate_vote").otherwise("weak_visual_fallback").alias("reason"))


@query("rare_class_rules", f"""
WITH {SIGNAL_SQL}, f AS (SELECT event_id, value / 10 AS gain, k >= 90 AS sat, CASE WHEN k % 3 = 0 THEN 'red|blue' WHEN k % 3 = 1 THEN 'green' ELSE 'red' END AS colors, (60 + event_id % 40) / 100.0 AS mx, (60 + event_id % 37) / 100.0 AS mean, k % 4 AS tracks,
  t_ms // 33 AS fb, t_ms // 33 - 1 AS fa, t_ms // 33 - k % 5 AS dis, t_ms // 33 - k % 7 AS en FROM sig)
SELECT event_id, NOT sat AND gain > 9.5 AND colors LIKE '%red%' AND mx >= 0.76 AS red_gate, sat AND tracks = 1 AND colors IN ('blue', 'green', 'red') AND mx >= 0.9 AND mean >= 0.9 AND dis >= fa - 1 AND dis <= fb AND en >= fa - 4 AND en <= dis AS override FROM f""")
def rare_class_rules(spark, folder):
    """Guarded rare class, and the override of a saturated pickup by one strong visual track."""
    k, e = F.col("k"), F.col("event_id")
    frame = F.expr("t_ms div 33")
    rows = signals(spark, folder).select(
        "event_id", (F.col("value") / 10).alias("gain"), (k >= 90).alias("sat"), F.when(k % 3 == 0, "red|blue").when(k % 3 == 1, "green").otherwise("red").alias("colors"), ((60 + e % 40) / 100.0).alias("mx"),
        ((60 + e % 37) / 100.0).alias("mean"), (k % 4).alias("tracks"), frame.alias("fb"), (frame - 1).alias("fa"), (frame - k % 5).alias("dis"), (frame - k % 7).alias("en"))
    c = F.col
    timing = (c("dis") >= c("fa") - 1) & (c("dis") <= c("fb")) & (c("en") >= c("fa") - 4) & (c("en") <= c("dis"))
    strong = c("sat") & (c("tracks") == 1) & c("colors").isin(*ops.COLOURS) & (c("mx") >= 0.9) & (c("mean") >= 0.9) & timing
    return rows.select("event_id", (~c("sat") & (c("gain") > 9.5) & (token_count(c("colors"), "red") > 0) & (c("mx") >= 0.76)).alias("red_gate"), strong.alias("override"))


_CONS_SQL = """
cn AS (SELECT event_id, color AS truth, CASE WHEN saturated THEN '' WHEN k % 10 < 6 THEN 'blue' ELSE 'green' END AS physics, candidate AS knn, CASE WHEN event_id % 13 = 0 THEN 'red' ELSE candidate END AS model, (50 + event_id % 50) / 100.0 AS prob, level_ok, event_id % 9 <> 0 AS isolated, saturated FROM ref),
ce AS (SELECT *, physics = knn AND physics = model AND physics <> '' AND level_ok AND isolated AND NOT saturated AS eligible FROM cn),
cg AS (SELECT v, count(*) AS n, avg(CASE WHEN model = truth THEN 1.0 ELSE 0 END) AS pr FROM ce, range(50, 100) AS r(v) WHERE eligible AND round(prob * 100, 6) >= v GROUP BY v),
ct AS (SELECT coalesce(arg_max(v, n * 1000 + v) FILTER (n >= 20 AND pr >= 0.9), 90) AS v FROM cg)"""


@query("consensus", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, {_CONS_SQL} SELECT event_id, v / 100 AS threshold, CASE WHEN eligible AND round(prob * 100, 6) >= v THEN model ELSE '' END AS prediction FROM ce, ct""")
def consensus(spark, folder):
    """Three methods must agree with enough confidence; the threshold keeps most events at the target precision."""
    c, e = F.col, F.col("event_id")
    rows = pickups(spark, folder).select(
        "event_id", c("color").alias("truth"), F.when(c("saturated"), "").when(c("k") % 10 < 6, "blue").otherwise("green").alias("physics"), c("candidate").alias("knn"),
        F.when(e % 13 == 0, "red").otherwise(c("candidate")).alias("model"), ((50 + e % 50) / 100.0).alias("prob"), "level_ok", (e % 9 != 0).alias("isolated"), "saturated")
    agree = (c("physics") == c("knn")) & (c("physics") == c("model")) & (c("physics") != "") & c("level_ok") & c("isolated") & ~c("saturated")
    rows = rows.withColumn("eligible", agree)
    table_ = ops.threshold_table(rows.filter("eligible"), c("model") == c("truth"), c("prob"), first=50, last=99)
    exact = c("true_positive") / c("predicted_positive")
    fits = (c("predicted_positive") >= 20) & (exact >= 0.9)
    best = table_.agg(F.coalesce(F.max_by("threshold", F.when(fits, F.struct("predicted_positive", "threshold"))), F.lit(0.9)).alias("threshold"))
    d = rows.withColumn("threshold", best.scalar())
    return d.select("event_id", "threshold", F.when(c("eligible") & (F.round(c("prob") * 100, 6) >= F.round(c("threshold") * 100)), c("model")).otherwise("").alias("prediction"))


@query("unresolved_outcomes", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, m AS (SELECT 'physics' AS version, CASE WHEN saturated THEN '' ELSE color END AS p FROM ref WHERE unresolved = 1 UNION ALL SELECT 'knn', candidate FROM ref WHERE unresolved = 1 UNION ALL SELECT 'consensus', CASE WHEN score >= 0.8 AND color = candidate THEN color ELSE '' END FROM ref WHERE unresolved = 1)
SELECT version, count(*) AS unresolved_input, count(*) FILTER (p <> '') AS assigned, count(*) FILTER (p = 'blue') AS blue, count(*) FILTER (p = 'green') AS green, count(*) FILTER (p = 'red') AS red, count(*) FILTER (p = '') AS remaining FROM m GROUP BY version""")
def unresolved_outcomes(spark, folder):
    c = F.col
    versions = F.explode(F.array(
        F.struct(F.lit("physics").alias("version"), F.when(c("saturated"), "").otherwise(c("color")).alias("p")), F.struct(F.lit("knn").alias("version"), c("candidate").alias("p")),
        F.struct(F.lit("consensus").alias("version"), F.when((c("score") >= 0.8) & (c("color") == c("candidate")), c("color")).otherwise("").alias("p")))).alias("m")
    p = c("m.p")
    return pickups(spark, folder).filter("unresolved = 1").select(versions).groupBy("m.version").agg(
        F.count(F.lit(1)).alias("unresolved_input"), F.count_if(p != "").alias("assigned"), *[F.count_if(p == colour).alias(colour) for colour in ops.COLOURS], F.count_if(p == "").alias("remaining"))


@query("before_after", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, m AS (SELECT 'before' AS stage, color = candidate AS ok FROM ref WHERE strict_color IS NOT NULL UNION ALL SELECT 'after', color = CASE WHEN score >= 0.8 THEN color ELSE candidate END FROM ref WHERE strict_color IS NOT NULL)
SELECT stage, count(*) AS events, count(*) FILTER (ok) AS correct, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS accuracy FROM m GROUP BY stage""")
def before_after(spark, folder):
    c = F.col
    stages = F.explode(F.array(F.struct(F.lit("before").alias("stage"), (c("color") == c("candidate")).alias("ok")),
                               F.struct(F.lit("after").alias("stage"), ((c("score") >= 0.8) | (c("color") == c("candidate"))).alias("ok")))).alias("m")
    return pickups(spark, folder).filter("strict_color IS NOT NULL").select(stages).groupBy("m.stage").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("m.ok").alias("correct"), F.round(F.avg(F.when(c("m.ok"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("feature_summary", f"""
WITH {SIGNAL_SQL}, f AS (SELECT 'hud_level' AS feature, CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(1 + k % 60 AS DOUBLE) END AS x FROM sig UNION ALL SELECT 'log_gain', round(log10(greatest(value, 0.001)), 6) FROM sig)
SELECT feature, count(*) - count(x) AS missing, min(x) AS min_value, max(x) AS max_value FROM f GROUP BY feature""")
def feature_summary(spark, folder):
    features = F.explode(F.array(F.struct(F.lit("hud_level").alias("feature"), F.when(F.col("k") % 13 != 0, (1 + F.col("k") % 60).cast("double")).alias("x")),
                                 F.struct(F.lit("log_gain").alias("feature"), F.round(F.log10(F.greatest("value", F.lit(0.001))), 6).alias("x")))).alias("f")
    return signals(spark, folder).select(features).groupBy("f.feature").agg((F.count(F.lit(1)) - F.count("f.x")).alias("missing"), F.min("f.x").alias("min_value"), F.max("f.x").alias("max_value"))
