"""Nearest points on grids against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.operators import classify


@pytest.mark.parametrize("levels", [None, 0, 9])
def test_nearest_points_are_exact(spark, levels):
    rng = np.random.default_rng(5)
    # a dense cluster with repeated rows, a sparse plane, and points far out
    x = np.vstack([rng.normal(size=(700, 2)) * 0.01, rng.uniform(-5, 5, (150, 2)), [[90.0, 90.0], [-40.0, 3.0]]])
    weight = rng.integers(1, 4, len(x))
    points = spark.createDataFrame([(*map(float, p), int(w), f"p{i}") for i, (p, w) in enumerate(zip(x, weight))], "a double, b double, rows long, name string")
    q = np.vstack([x[:20], rng.uniform(-6, 6, (60, 2)), [[500.0, -500.0], [0.0, 0.0], [90.0, 90.0]]])
    places = spark.createDataFrame([tuple(map(float, p)) for p in q], "a double, b double")
    got = {(r.a, r.b): r.z for r in classify.nearest_points(places, points, ["a", "b"], "rows", 9, levels=levels).collect()}
    assert len(got) == len({tuple(p) for p in q.tolist()})
    for p in q.tolist():
        far = np.sqrt(((x - p) ** 2).sum(1))
        order = np.lexsort((x[:, 1], x[:, 0], far))
        rows, need = 0, []
        for i in order:  # as many points as give nine rows
            if rows >= 9:
                break
            need.append(f"p{i}")
            rows += weight[i]
        assert [z.name for z in got[tuple(p)]][:len(need)] == need


def test_votes_without_reference_or_position(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, "x"), (2, None, 1.0, "x")], "event_id long, a double, b double, label string")
    assert classify.nearest_votes(rows, rows.limit(0), ["a", "b"], "label", ["x", "y"]).count() == 0
    out = classify.nearest_votes(rows, rows, ["a", "b"], "label", ["x", "y"]).collect()
    assert [(r.event_id, r.p_x, r.p_y) for r in out] == [(1, 1.0, 0.0)]


def test_combined_prediction_order_of_evidence(spark):
    rows = [  # id, p, rare, saturated, strong, seen, score
        (1, (0.2, 0.5, 0.3), False, False, False, "red", 0.9), (2, (0.4, 0.4, 0.2), None, None, None, None, None), (3, (0.9, 0.1, 0.0), True, False, False, "red|blue", 0.8),
        (4, (0.9, 0.1, 0.0), True, True, False, "red", 0.8), (5, (0.9, 0.1, 0.0), True, True, True, "green", 1.0), (6, (None, None, None), False, False, False, "red", 0.9),
        (7, (None, None, None), True, None, None, None, None), (8, (0.1, 0.2, 0.7), False, True, True, "purple", 0.95)]
    df = spark.createDataFrame([(i, *p, *rest) for i, p, *rest in rows], "event_id long, p_blue double, p_green double, p_red double, rare boolean, sat boolean, strong boolean, seen string, score double")
    c = F.col
    fused = lambda df: classify.combined_prediction(df, ["blue", "green", "red"], rare_label="red", rare=c("rare"), saturated=c("sat"), override=c("strong"), seen_label=c("seen"), score=c("score"))
    got = {r.event_id: (r.prediction, r.reason, tuple(round(r[f"p_{x}"], 6) for x in ("blue", "green", "red"))) for r in fused(df).collect()}
    assert got == {
        1: ("green", "model_probability", (0.2, 0.5, 0.3)), 2: ("blue", "model_probability", (0.4, 0.4, 0.2)), 3: ("red", "guarded_rare_class", (0, 0, 0.93)),
        4: ("", "saturated_unresolved", (0, 0, 0)), 5: ("green", "single_strong_track", (0.005, 0.99, 0.005)), 6: ("", "no_model", (0, 0, 0)),
        7: ("red", "guarded_rare_class", (0, 0, 0.65)), 8: ("", "saturated_unresolved", (0, 0, 0))}
    assert fused(df.limit(0)).count() == 0


def test_forest_probabilities_of_unknown_labels(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), "blue" if i % 2 else "green") for i in range(60)], "event_id long, a double, b double, label string")
    model = classify.fit_forest(rows, ["a", "b"], "label", trees=5)
    out = classify.forest_probabilities(model, rows, "event_id", ["blue", "green", "red"]).collect()
    assert len(out) == 60 and all(r.p_red == 0.0 and abs(r.p_blue + r.p_green - 1) < 1e-9 for r in out)


def test_every_place_is_asked_once(spark, monkeypatch):
    """Places in sparse stretches do not go up the levels one job after the other."""
    cuts, plain = [], classify.cut_lineage
    monkeypatch.setattr(classify, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    points = spark.createDataFrame([(float(i % 40) ** 3, float(i // 40), 1) for i in range(400)], "a double, b double, rows long")
    found = classify.nearest_points(points, points, ["a", "b"], "rows", 9, levels=8).collect()
    assert len(found) == 400 and all(len(r.z) == 9 and r.z[0].d == 0 for r in found)
    assert len(cuts) == 3


def test_forest_trains_on_all_cores(spark, monkeypatch):
    """A small file is one task, but its forest is not."""
    from pyspark.ml import Pipeline

    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), "blue" if i % 2 else "green") for i in range(200)], "event_id long, a double, b double, label string").coalesce(1)
    seen, plain = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())) or plain(self, df))
    classify.fit_forest(rows, ["a", "b"], "label", trees=3)
    assert seen == [(spark.sparkContext.defaultParallelism, 200)]
