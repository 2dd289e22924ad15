"""Nearest-neighbour and forest classifiers on pickup features."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.functions.scalars import first_max_name, token_count
from sessionlake.operators import classify as ops, evaluation
from sessionlake.operators.counters import value_band
from sessionlake.plans.evaluation import _EVENT_SQL, pickups
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import SIGNAL_SQL

COLOURS = evaluation.COLOURS
FEATURES = ["hud_level", "log_increase", "log_gain", "confidence", "score", "tracks", "weak_green"]
TREES = 500


def feature_rows(spark, folder):
    k = F.col("k")
    return pickups(spark, folder).select(
        "event_id", "color", "strict_color", "unresolved", (1 + k % 60).cast("double").alias("hud_level"), F.round(F.log10(F.greatest("value", F.lit(0.001))), 4).alias("log_increase"),
        F.when(k % 13 != 0, F.round(F.log10(F.greatest(F.col("value") / 10 + (k % 10) * 3, F.lit(0.001))), 4)).alias("log_gain"), "confidence", "score",
        F.col("tracks").cast("double").alias("tracks"), (F.col("candidate") == "green").cast("double").alias("weak_green"))


_KNN_SQL = """
fr AS (SELECT event_id, strict_color, unresolved, CAST(1 + k % 60 AS DOUBLE) AS a, round(log10(greatest(value, 0.001)), 4) AS b FROM ref),
sc AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM fr WHERE strict_color IS NOT NULL),
z AS (SELECT event_id, strict_color, unresolved, (a - ma) / sa AS x, (b - mb) / sb AS y FROM fr, sc),
nb AS (SELECT q.event_id, r.strict_color AS c, sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)) AS d, r.x AS rx, r.y AS ry FROM z q JOIN z r ON q.unresolved = 1 AND r.strict_color IS NOT NULL),
tk AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, rx, ry, c) <= 31),
wt AS (SELECT event_id, c, CASE WHEN bool_or(d = 0) OVER (PARTITION BY event_id) THEN CASE WHEN d = 0 THEN 1.0 ELSE 0 END ELSE 1 / d END AS w FROM tk),
vt AS (SELECT event_id, sum(w) FILTER (c = 'blue') / sum(w) AS b, sum(w) FILTER (c = 'green') / sum(w) AS g, sum(w) FILTER (c = 'red') / sum(w) AS r FROM wt GROUP BY event_id)"""


@query("knn_vote", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, {_KNN_SQL}
SELECT event_id, round(coalesce(b, 0), 6) AS p_blue, round(coalesce(g, 0), 6) AS p_green, round(coalesce(r, 0), 6) AS p_red, CASE WHEN coalesce(b, 0) >= coalesce(g, 0) AND coalesce(b, 0) >= coalesce(r, 0) THEN 'blue' WHEN coalesce(g, 0) >= coalesce(r, 0) THEN 'green' ELSE 'red' END AS prediction FROM vt""")
def knn_vote(spark, folder):
    rows = feature_rows(spark, folder)
    d = ops.nearest_votes(rows.filter("unresolved = 1"), rows.filter("strict_color IS NOT NULL"), ["hud_level", "log_increase"], "strict_color", COLOURS)
    d = d.withColumns({f"p_{c}": F.round(f"p_{c}", 6) for c in COLOURS})
    return d.withColumn("prediction", first_max_name(COLOURS, [F.col(f"p_{c}") for c in COLOURS]))


_FUSION_SQL = """
ev AS (SELECT event_id, value / 5 AS gain, event_id % 4 = 0 AS sat, CASE event_id // 4 % 3 WHEN 0 THEN 'red|blue' WHEN 1 THEN 'green' ELSE 'red' END AS colors, (60 + event_id % 40) / 100.0 AS mx, (58 + event_id % 40) / 100.0 AS mean,
  event_id // 12 % 2 AS tracks, t_ms // 33 AS fb, t_ms // 33 - 1 AS fa, t_ms // 33 - event_id % 3 AS dis, t_ms // 33 - event_id % 3 - event_id % 7 AS en FROM sig),
eg AS (SELECT *, NOT sat AND gain > 9.5 AND colors LIKE '%red%' AND mx >= 0.76 AS rare, sat AND tracks = 1 AND colors IN ('blue', 'green', 'red') AND mx >= 0.9 AND mean >= 0.9 AND dis BETWEEN fa - 1 AND fb AND en BETWEEN fa - 4 AND dis AS strong,
  CASE WHEN sat OR gain IS NULL OR gain <= 0 THEN '' WHEN gain <= 2.25 THEN 'blue' WHEN gain <= 9.5 THEN 'green' ELSE 'red' END AS band FROM ev),
kn AS (SELECT event_id, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(r, 0) AS r FROM vt),
fu AS (SELECT eg.*, b, g, r, CASE WHEN b IS NULL THEN '' WHEN b >= g AND b >= r THEN 'blue' WHEN g >= r THEN 'green' ELSE 'red' END AS near, least(0.99, mx) AS s, least(0.99, 0.65 + 0.35 * mx) AS q,
  CASE WHEN strong THEN 'single_strong_track' WHEN sat THEN 'saturated_unresolved' WHEN rare THEN 'guarded_rare_class' WHEN b IS NOT NULL THEN 'model_probability' ELSE 'no_model' END AS reason
  FROM eg JOIN (SELECT event_id FROM ref WHERE unresolved = 1) USING (event_id) LEFT JOIN kn USING (event_id)),
fd AS (SELECT *, CASE reason WHEN 'single_strong_track' THEN colors WHEN 'guarded_rare_class' THEN 'red' WHEN 'model_probability' THEN near ELSE '' END AS prediction FROM fu)"""


def pickup_evidence(spark, folder):
    """Value gain, saturation and visual track of the pickups whose colour is open, with the two rules that outrank a model."""
    c, e = F.col, F.col("event_id")
    frame = F.expr("t_ms div 33")
    turn = F.expr("event_id div 4 % 3")
    d = pickups(spark, folder).filter("unresolved = 1").select(
        "event_id", (c("value") / 5).alias("gain"), (e % 4 == 0).alias("sat"), F.when(turn == 0, "red|blue").when(turn == 1, "green").otherwise("red").alias("colors"), ((60 + e % 40) / 100.0).alias("mx"),
        ((58 + e % 40) / 100.0).alias("mean"), F.expr("event_id div 12 % 2").alias("tracks"), frame.alias("fb"), (frame - 1).alias("fa"), (frame - e % 3).alias("dis"), (frame - e % 3 - e % 7).alias("en"))
    timing = c("dis").between(c("fa") - 1, c("fb")) & c("en").between(c("fa") - 4, c("dis"))
    return d.select("event_id", "sat", "colors", "mx", value_band(c("gain"), c("sat"), 2.25, 9.50, "").alias("band"),
                    (~c("sat") & (c("gain") > 9.5) & (token_count(c("colors"), "red") > 0) & (c("mx") >= 0.76)).alias("rare"),
                    (c("sat") & (c("tracks") == 1) & c("colors").isin(*COLOURS) & (c("mx") >= 0.9) & (c("mean") >= 0.9) & timing).alias("strong"))


def _neighbour_probabilities(spark, folder):
    rows = feature_rows(spark, folder)
    return ops.nearest_votes(rows.filter("unresolved = 1"), rows.filter("strict_color IS NOT NULL"), ["hud_level", "log_increase"], "strict_color", COLOURS)


def _fused(evidence):
    c = F.col
    return ops.combined_prediction(evidence, COLOURS, rare_label="red", rare=c("rare"), saturated=c("sat"), override=c("strong"), seen_label=c("colors"), score=c("mx"))


@query("combined_prediction", f"""
WITH {SIGNAL_SQL}, {_EVENT_SQL}, {_KNN_SQL}, {_FUSION_SQL}
SELECT event_id, prediction, reason, band, near AS neighbours, CAST((prediction <> '' AND band = prediction)::INT + (prediction <> '' AND near = prediction)::INT AS INTEGER) AS agreeing,
  round(CASE reason WHEN 'single_strong_track' THEN CASE WHEN colors = 'blue' THEN s ELSE (1 - s) / 2 END WHEN 'model_probability' THEN b ELSE 0 END, 6) AS p_blue,
  round(CASE reason WHEN 'single_strong_track' THEN CASE WHEN colors = 'green' THEN s ELSE (1 - s) / 2 END WHEN 'model_probability' THEN g ELSE 0 END, 6) AS p_green,
  round(CASE reason WHEN 'single_strong_track' THEN CASE WHEN colors = 'red' THEN s ELSE (1 - s) / 2 END WHEN 'guarded_rare_class' THEN q WHEN 'model_probability' THEN r ELSE 0 END, 6) AS p_red FROM fd""")
def combined_prediction(spark, folder):
    """Neighbour votes, value band, guarded rare class and strong tracks fused into one decision with its reason and the methods that agree."""
    votes = _neighbour_probabilities(spark, folder)
    d = pickup_evidence(spark, folder).join(votes, "event_id", "left")
    d = d.withColumn("neighbours", F.coalesce(first_max_name(COLOURS, [F.col(f"p_{c}") for c in COLOURS]), F.lit("")))
    d = _fused(d)
    agrees = [((F.col("prediction") != "") & (F.col(name) == F.col("prediction"))).cast("int") for name in ("band", "neighbours")]
    return d.select("event_id", "prediction", "reason", "band", "neighbours", (agrees[0] + agrees[1]).alias("agreeing"), *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in COLOURS])


@query("combined_forest")
def combined_forest(spark, folder):
    """The same fusion over a forest that learns the common colours only; the rare one is left to its guarded rule."""
    rows = feature_rows(spark, folder)
    model = ops.fit_forest(rows.filter("strict_color <> 'red'"), FEATURES, "strict_color", trees=TREES)
    votes = ops.forest_probabilities(model, rows.filter("unresolved = 1"), "event_id", COLOURS)
    d = _fused(pickup_evidence(spark, folder).join(votes, "event_id", "left"))
    return d.select("event_id", "prediction", "reason", "band", *[f"p_{c}" for c in COLOURS])


@query("stratified_folds")
def stratified_folds(spark, folder):
    rows = feature_rows(spark, folder).filter("strict_color IS NOT NULL")
    return ops.stratified_folds(rows, "strict_color", "event_id").select("event_id", "strict_color", "fold")


@query("forest_oof")
def forest_oof(spark, folder):
    """Class report of out-of-fold forest predictions."""
    rows = feature_rows(spark, folder).filter("strict_color IS NOT NULL")
    d = ops.out_of_fold(rows, FEATURES, "strict_color", "event_id", trees=TREES)
    return evaluation.class_report(evaluation.confusion(d, "strict_color", "prediction"), "strict_color", "prediction", COLOURS)


@query("forest_importance")
def forest_importance(spark, folder):
    model = ops.fit_forest(feature_rows(spark, folder).filter("strict_color IS NOT NULL"), FEATURES, "strict_color", trees=TREES)
    return ops.importances(model, FEATURES, spark)


@query("forest_assignment")
def forest_assignment(spark, folder):
    """Forest predictions for unresolved pickups."""
    rows = feature_rows(spark, folder)
    model = ops.fit_forest(rows.filter("strict_color IS NOT NULL"), FEATURES, "strict_color", trees=TREES)
    return ops.forest_predictions(model, rows.filter("unresolved = 1"), "event_id")
