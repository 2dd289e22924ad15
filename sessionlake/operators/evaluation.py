"""Calibration, gates and evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.scalars import safe_rate, wilson_lower
from sessionlake.operators.folds import session_fold
from sessionlake.operators.ordering import TimeOrder

COLOURS = ("blue", "green", "red")
MINIMUM_PREDICTIONS = 20
TARGET_PRECISION = 0.95


def split_label(time_s: Column, calibration_end: float = 210.0, validation_end: float = 300.0) -> Column:
    return F.when(time_s < calibration_end, "calibration").when(time_s < validation_end, "validation").otherwise("deployment")


def metric_columns(truth: Column, predicted: Column) -> list[Column]:
    """Counts of a binary task; finish with :func:`with_rates`."""
    return [F.count(F.lit(1)).alias("reference_events"), F.count_if(truth).alias("actual_positive"), F.count_if(predicted).alias("predicted_positive"),
            F.count_if(truth & predicted).alias("true_positive"), F.count_if(~truth & predicted).alias("false_positive"),
            F.count_if(truth & ~predicted).alias("false_negative")]


def with_rates(counts: DataFrame, digits: int = 4) -> DataFrame:
    c = F.col
    return counts.withColumns({
        "precision": F.round(safe_rate(c("true_positive"), c("predicted_positive")), digits),
        "precision_lower": F.round(wilson_lower(c("true_positive"), c("predicted_positive")), digits),
        "recall": F.round(safe_rate(c("true_positive"), c("actual_positive")), digits)})


def threshold_table(rows: DataFrame, truth: Column, score: Column, *, first: int = 60, last: int = 96) -> DataFrame:
    """Metrics of every threshold ``first..last`` hundredths from one pass.

    Rows are counted by the highest threshold they reach, then summed from the top; rows are not multiplied by the grid.
    ``score`` is NULL where nothing is predicted.
    """
    cell = F.least(F.floor(F.round(score * 100, 6)), F.lit(last)).cast("long")
    counted = rows.groupBy(F.when(cell >= first, cell).alias("cell")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    grid = rows.sparkSession.range(first, last + 1).select(F.col("id").alias("cell"), F.lit(0).alias("pos"), F.lit(0).alias("neg"))
    cells = counted.unionByName(grid).groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # one row per grid point, so these windows are as small as the grid
    down = Window.orderBy(F.desc_nulls_last("cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc_nulls_last("cell")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = cells.select("cell", F.sum("pos").over(whole).alias("_pos"), F.sum("neg").over(whole).alias("_neg"), F.sum("pos").over(down).alias("true_positive"),
                     F.sum("neg").over(down).alias("false_positive")).filter("cell IS NOT NULL")
    d = d.select((F.col("cell") / 100).alias("threshold"), (F.col("_pos") + F.col("_neg")).alias("reference_events"), F.col("_pos").alias("actual_positive"),
                 (F.col("true_positive") + F.col("false_positive")).alias("predicted_positive"), "true_positive", "false_positive",
                 (F.col("_pos") - F.col("true_positive")).alias("false_negative"))
    return with_rates(d)


def chosen_threshold(table: DataFrame, *, minimum: int = MINIMUM_PREDICTIONS, target: float = TARGET_PRECISION) -> DataFrame:
    """Most predictions at the target precision; failing that the best precision. Lower thresholds win ties."""
    good = (F.col("predicted_positive") >= minimum) & (F.col("precision") >= target)
    rank = F.struct(good.cast("int").alias("ok"), F.when(good, F.col("predicted_positive").cast("double")).otherwise(F.col("precision")).alias("a"),
                    F.when(good, F.lit(0)).otherwise(F.col("predicted_positive")).alias("b"), (-F.col("threshold")).alias("c"))
    return table.agg(F.max_by(F.struct(*table.columns), rank).alias("_r")).select("_r.*")


def gate_passes(predicted: Column, precision: Column, *, minimum: int = MINIMUM_PREDICTIONS, target: float = TARGET_PRECISION) -> Column:
    return F.coalesce((predicted >= minimum) & (precision >= target), F.lit(False))


def confusion(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    return rows.groupBy(truth, prediction).agg(F.count(F.lit(1)).alias("n"))


def class_report(cells: DataFrame, truth: str, prediction: str, labels: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 per class from a confusion table; an empty prediction counts as unassigned."""
    d = cells.withColumn("label", F.explode(F.array(*[F.lit(label) for label in labels])))
    given = F.col(prediction) != ""
    total = lambda condition: F.sum(F.when(condition & given, F.col("n")).otherwise(0))
    is_true, is_guess = F.col(truth) == F.col("label"), F.col(prediction) == F.col("label")
    d = d.groupBy("label").agg(total(is_true & is_guess).alias("tp"), total(is_guess).alias("predicted"), total(is_true).alias("support"), F.sum("n").alias("rows"))
    p, r = safe_rate(F.col("tp"), F.col("predicted")), safe_rate(F.col("tp"), F.col("support"))
    return d.select("label", "support", "predicted", "tp", "rows", p.alias("precision"), r.alias("recall"), safe_rate(2 * p * r, p + r).alias("f1"))


def overall_report(report: DataFrame) -> DataFrame:
    """Accuracy on assigned rows, balanced accuracy over the classes present, macro F1 and coverage."""
    return report.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
                      F.avg("f1").alias("macro_f1"), F.sum("support").alias("assigned"), (F.sum("support") / F.max("rows")).alias("coverage"))


def error_metrics(actual: Column, predicted: Column) -> list[Column]:
    error = (predicted - actual).cast("double")
    gap = F.abs(error)
    share = lambda k: F.avg(F.when(gap <= k, 1.0).otherwise(0.0))
    return [F.count(F.lit(1)).alias("matched"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(gap).alias("mae"), F.avg(error).alias("bias"),
            F.max(gap).alias("max_error"), share(0).alias("exact"), share(1).alias("within_1"), share(5).alias("within_5")]


def rolling_growth(rows: DataFrame, order: TimeOrder, *, fixed: float = 1.0, history: int = 40, minimum: int = 12) -> DataFrame:
    """Growth correction from the last accepted isolated pickups; whether one is accepted depends on the factor in force.

    ``rows``: ``split, gain, reference`` (``reference`` marks certain isolated single pickups).
    """

    def step(recent, row):
        ident, split, gain, reference = row
        recent = recent or []
        ready = split == "deployment" and len(recent) >= minimum
        if ready:
            ordered = sorted(recent)
            n = len(ordered)
            factor = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
        else:
            factor = fixed
        source = ("rolling_past_visual_blue" if ready else "fixed_calibration_frozen_validation" if split == "validation"
                  else "fixed_calibration_fallback" if split == "deployment" else "fixed_calibration")
        out = [(ident, factor, source, len(recent), gain / factor)]
        if reference:
            ratio = gain / (1.0 if gain / max(factor, 1e-6) < 1.5 else 2.0)
            if 0.65 <= ratio <= 1.40:
                recent = (recent + [ratio])[-history:]
        return recent, out

    tie = order.by[-1]
    return session_fold(rows, order, [tie, "split", "gain", "reference"], step,
                        f"{tie} long, factor double, factor_source string, recent_samples long, calibrated_gain double")
