"""Splitting a large session changes the plan, never the result."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlake.operators.binning import centered_mean, group_quantiles
from sessionlake.operators.counters import confirmed_drops, isolated_repair, leading_shift_repair
from sessionlake.operators.folds import session_fold
from sessionlake.operators.intervals import merge_overlapping, runs
from sessionlake.operators.machines import COIN_COLUMNS, coin_counter, coin_step
from sessionlake.operators.ordering import GROUP_ROWS_CONF, last_seen, next_seen, running_max, running_sum, time_order
from sessionlake.operators.timejoin import asof, first_containing, nearest, unique_nearest


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for session, size in ((1, 500), (2, 20), (3, 60)):
        for _ in range(size):
            t = 5_000 if session == 1 and rng.random() < 0.4 else rng.randrange(0, 20_000)
            data.append((session, t, len(data), rng.randrange(100) if rng.random() < 0.85 else None, rng.random() < 0.15))
    return spark.createDataFrame(data, "session_id long, t_ms long, event_id long, v long, stop boolean").cache()


def both(spark, build):
    spark.conf.set(GROUP_ROWS_CONF, "10000000")
    plain = sorted(map(tuple, build().collect()), key=repr)
    spark.conf.set(GROUP_ROWS_CONF, "25")
    try:
        split = sorted(map(tuple, build().collect()), key=repr)
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    assert plain and plain == split


def test_pieces_are_small(rows):
    order = time_order(rows, limit=25)
    assert order.split
    biggest = order.tag(rows).groupBy("session_id", "_piece").count().agg(F.max("count")).first()[0]
    assert biggest <= 75


def test_windows(spark, rows):
    def build():
        o = time_order(rows)
        d = o.frames(o.tag(rows), 3, a=lambda w: F.lag("v").over(w), b=lambda w: F.lead("v", 3).over(w), c=lambda w: F.max("v").over(w.rowsBetween(-3, 2)))
        return o.untag(o.running(d, s=running_sum(F.col("v")), m=running_max(F.col("v"), True), l=last_seen(F.col("v"), True), n=next_seen(F.col("v"))))

    both(spark, build)


def test_joins(spark, rows):
    right = rows.filter("v % 7 = 0").select("session_id", "t_ms", F.col("event_id").alias("rid"), F.col("v").alias("rv"))
    both(spark, lambda: asof(rows, right, ["rv", "rid"], right_tie="rid"))
    both(spark, lambda: nearest(rows, right, ["rid"], 300, right_tie="rid"))
    boxes = right.select("session_id", "rid", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + F.col("rv") * 20).alias("end_ms"))
    both(spark, lambda: first_containing(rows, boxes, ["rid"], interval_tie="rid"))
    points = rows.withColumn("p", F.col("t_ms") + 50)
    both(spark, lambda: unique_nearest(points, right.withColumnRenamed("rid", "event_id"), time="p", low=F.col("p") - 400, high=F.col("p") + 400, margin=30))


def test_intervals(spark, rows):
    both(spark, lambda: runs(rows, time_order(rows), F.coalesce(F.col("v") < 60, F.lit(False)), gap_ms=200, interrupted=F.col("stop")))
    spans = rows.filter("v IS NOT NULL").select("session_id", "event_id", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + F.col("v")).alias("end_ms"))
    both(spark, lambda: merge_overlapping(spans, aggs=[F.count(F.lit(1)).alias("n")]))


def test_counters(spark, rows):
    points = rows.filter("v IS NOT NULL").withColumn("c", F.col("t_ms") + F.when(F.col("event_id") % 23 == 0, 4_000).otherwise(0)).select("session_id", "t_ms", "event_id", "c")
    both(spark, lambda: isolated_repair(points, time_order(points), "c"))
    both(spark, lambda: leading_shift_repair(points, time_order(points), "c"))
    menus = rows.withColumn("left", F.expr("20 - t_ms div 1500 + IF(v % 9 = 0, -3, 0)"))
    both(spark, lambda: confirmed_drops(menus, time_order(menus), "left"))


def test_means_and_quantiles(spark, rows):
    known = rows.filter("v IS NOT NULL")
    both(spark, lambda: centered_mean(known, time_order(known), value="v", half_ms=700).withColumn("mean", F.round("mean", 6)))
    both(spark, lambda: group_quantiles(rows, ["session_id"], "v", {"a": 0.2, "b": 0.5, "c": 0.95}))


def coins(rows):
    return rows.select("session_id", F.col("t_ms"), "event_id", F.col("stop").alias("paused"), (F.col("t_ms") % 6_000 < 2_000).alias("fever"),
                       F.expr("IF(v % 17 = 0, NULL, t_ms div 500 * 10 + IF(v % 13 = 0, 9000, 0))").alias("candidate"), F.lit(0.97).alias("confidence"))


def test_fold(spark, rows):
    samples = coins(rows)
    both(spark, lambda: coin_counter(samples, time_order(samples)))
    plain = [tuple(r) for r in samples.orderBy("session_id", "t_ms", "event_id").select("session_id", *COIN_COLUMNS).collect()]
    expected, state, current = [], None, None
    for session, *row in plain:
        if session != current:
            state, current = None, session
        state, out = coin_step(state, tuple(row))
        expected += [(session, *o) for o in out]
    got = sorted(map(tuple, coin_counter(samples, time_order(samples)).collect()))
    assert got == sorted(expected)


def test_fold_that_never_forgets(spark, rows):
    def step(total, row):
        ident, v = row
        total = (total or 0) + (v or 0)
        return total, [(ident, total)]

    both(spark, lambda: session_fold(rows, time_order(rows), ["event_id", "v"], step, "event_id long, total long", finish=lambda s: [(-1, s)]))
