"""Detections, tracks and trajectories on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.operators import detections as ops
from sessionlake.operators.ordering import time_order
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import SIGNAL_SQL, signals, table

# fixed values: scale of the mapped pixel plane
PLANE = 1000.0

_DET_SQL = """
det AS (SELECT vec_id AS det_id, vec_id % 3 AS session_id, label AS code, vec_id // 10 AS frame, vec_id // 10 * 250 AS t_ms, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, CAST(embedding[3] AS DOUBLE) AS score FROM embeddings)"""


def detections(spark, folder):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("det_id"), (F.col("vec_id") % 3).alias("session_id"), F.col("label").alias("code"), F.expr("vec_id div 10").alias("frame"),
        F.expr("vec_id div 10 * 250").alias("t_ms"), (e(0) * PLANE).alias("x"), (e(1) * PLANE).alias("y"), e(2).alias("score"))


@query("nms", f"""
WITH RECURSIVE {_DET_SQL}, o AS (SELECT frame, det_id, x, y, score, row_number() OVER (PARTITION BY frame ORDER BY -round(score * 1000000000), det_id) AS i FROM det),
r AS (SELECT frame, i, det_id, TRUE AS keep, [{{'x': x, 'y': y}}] AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.frame, o.i, o.det_id, len(list_filter(r.kept, lambda p: sqrt((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y)) <= 60)) = 0,
    CASE WHEN len(list_filter(r.kept, lambda p: sqrt((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y)) <= 60)) = 0 THEN list_append(r.kept, {{'x': o.x, 'y': o.y}}) ELSE r.kept END
  FROM r JOIN o ON o.frame = r.frame AND o.i = r.i + 1)
SELECT r.frame, r.det_id, round(x, 6) AS x, round(y, 6) AS y, round(score, 6) AS score FROM r JOIN det USING (det_id) WHERE keep""")
def nms(spark, folder):
    d = ops.suppressed(detections(spark, folder), ["frame"], 60.0)
    return d.withColumns({name: F.round(name, 6) for name in ("x", "y", "score")})


def _stops(spark, folder):
    return detections(spark, folder).filter("frame % 11 = 0").select("session_id", "t_ms").distinct()


@query("tracks")
def tracks(spark, folder):
    return ops.tracks(detections(spark, folder), _stops(spark, folder), reach=300.0).select("session_id", "code", "det_id", "track_id", "t_ms")


@query("track_candidates")
def track_candidates(spark, folder):
    joined = ops.tracks(detections(spark, folder), _stops(spark, folder), reach=300.0)
    return ops.pickup_candidates(joined, _stops(spark, folder), center=(0.0, 0.0), final_ms=1_000_000_000, period_ms=250)


def _moving(spark, folder):
    """Detections as slow movers around the player, so that frames can be linked."""
    d = detections(spark, folder).withColumn("frame", F.expr("det_id div 6"))
    d = d.withColumns({"code": F.col("det_id") % 6, "x": F.col("det_id") % 6 * 150 - 300 + F.col("x") * 0.1 + (F.col("frame") % 10) * 8, "y": F.col("y") * 0.1, "session_id": F.expr("frame div 100"),
                       "score": 0.85 + F.abs("score") * 0.3})
    return d.withColumn("distance", F.hypot("x", "y"))


def _paths(spark, folder):
    rows = _moving(spark, folder)
    return ops.linked_paths(rows, time_order(rows, ("session_id", "code"), ("frame", "det_id")))


@query("persistent_matching")
def persistent_matching(spark, folder):
    return _paths(spark, folder).select("session_id", "code", "det_id", "frame", "persists", F.size("path_frames").alias("path_length"))


@query("trajectory_evidence")
def trajectory_evidence(spark, folder):
    rows = _moving(spark, folder)
    events = rows.filter("det_id % 12 = 0").select("session_id", F.col("det_id").alias("event_id"), F.col("frame").alias("frame_b"), F.greatest(F.lit(0), F.col("frame") - 8).alias("first_frame"))
    paths = _paths(spark, folder)
    # every sixth place goes dark for a frame, so that objects vanish near the player
    d = ops.trajectory_evidence(events, paths.withColumn("persists", F.col("persists") & (F.col("det_id") % 5 != 0)), pickup_radius=400.0, minimum_approach=5.0, tolerance=30.0, minimum_monotonic=0.4)
    return d.select("session_id", "event_id", "code", "det_id", "gone", F.round("approach", 6).alias("approach"), F.round("monotonic", 6).alias("monotonic"), F.round("evidence_score", 6).alias("evidence_score"))


@query("distinct_trajectories")
def distinct_trajectories(spark, folder):
    places = _moving(spark, folder).select("det_id", "x", "y")
    found = trajectory_evidence(spark, folder).join(places, "det_id")
    return ops.distinct_trajectories(found, distance=200.0)


@query("entry_tracker")
def entry_tracker(spark, folder):
    rows = _moving(spark, folder).withColumn("radius", F.lit(120.0) + (F.col("frame") % 20) * 6.0)
    d = ops.entry_tracker(rows, time_order(rows, ("session_id", "code"), ("frame", "det_id")), minimum_approach=4.0, minimum_monotonic=0.4, minimum_confidence=0.5)
    return d.withColumns({name: F.round(name, 6) for name in ("entry_distance", "radial_speed", "mean_score", "monotonic", "confidence")})


@query("radial_flow")
def radial_flow(spark, folder):
    rows = _moving(spark, folder)
    d = ops.radial_flow(rows, time_order(rows, "session_id", ("frame", "det_id")), center=(0.0, 0.0), dt_s=0.5)
    return d.withColumns({name: F.round(name, 6) for name in ("inward_fraction", "median_inward_speed", "net_median_speed")})


@query("separability", f"""
WITH {_DET_SQL}, a AS (SELECT code, coalesce(max(score + CASE WHEN det_id % 2 = 0 THEN 0.25 * (code % 4) ELSE 0 END) FILTER (det_id % 2 = 1), 1.0) AS nm, coalesce(min(score + CASE WHEN det_id % 2 = 0 THEN 0.25 * (code % 4) ELSE 0 END) FILTER (det_id % 2 = 0), 0.0) AS pm FROM det GROUP BY ALL)
SELECT code, round(nm, 6) AS negative_max, round(pm, 6) AS positive_min, round(pm - nm, 6) AS margin, pm > nm + 0.04 AS separable, round(CASE WHEN pm > nm + 0.04 THEN (nm + pm) / 2 ELSE 1.0 END, 6) AS threshold FROM a""")
def separability(spark, folder):
    positive = F.col("det_id") % 2 == 0
    score = F.col("score") + F.when(positive, 0.25 * (F.col("code") % 4)).otherwise(0.0)
    d = ops.separability(detections(spark, folder), "code", positive, score)
    return d.withColumns({name: F.round(name, 6) for name in ("negative_max", "positive_min", "margin", "threshold")})


@query("content_changes", """
WITH v AS (SELECT vec_id // 4 + CASE WHEN vec_id % 37 = 0 THEN 1 ELSE 0 END AS menu, vec_id AS pos, embedding FROM embeddings), m AS (SELECT menu, count(*) AS n FROM v GROUP BY ALL),
l AS (SELECT menu // 50 AS session_id, menu, n, lag(menu) OVER w AS pm, lag(n) OVER w AS pn FROM m WINDOW w AS (PARTITION BY menu // 50 ORDER BY menu)),
r AS (SELECT menu, row_number() OVER (PARTITION BY menu ORDER BY pos) AS i, embedding FROM v),
d AS (SELECT l.menu, min(list_sum(list_transform(range(1, 65), lambda q: CAST(a.embedding[q] AS DOUBLE) * CAST(b.embedding[q] AS DOUBLE)))) AS s FROM l JOIN r a ON a.menu = l.menu JOIN r b ON b.menu = l.pm AND b.i = a.i GROUP BY l.menu)
SELECT l.session_id, l.menu, round(CASE WHEN n = pn THEN s END, 6) AS least_similarity, CASE WHEN pm IS NULL THEN NULL WHEN n <> pn THEN TRUE ELSE coalesce(s < 0.1, FALSE) END AS changed FROM l LEFT JOIN d USING (menu)""")
def content_changes(spark, folder):
    """Menus whose icons changed since the one before; one icon in 37 stands in the next menu, so that menus differ in length."""
    menu = F.expr("vec_id div 4 + CASE WHEN vec_id % 37 = 0 THEN 1 ELSE 0 END")
    menus = table(spark, folder, "embeddings").groupBy(menu.alias("menu")).agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("p"), F.col("embedding").alias("e")))).alias("l"))
    rows = menus.select(F.expr("menu div 50").alias("session_id"), "menu", F.transform("l", lambda x: x["e"]).alias("vectors"))
    return ops.content_changes(rows, time_order(rows, "session_id", ("menu", "menu")), "vectors", 0.1).select("session_id", "menu", "least_similarity", "changed")


REWARD_NAMES = [f"item_{i}" for i in range(4)]  # a fifth name is read, but no chest may hold it


def _reward_scores(spark, folder):
    k = F.col("k")
    rows = signals(spark, folder).groupBy(F.col("session_id").alias("chest"), F.expr("t_ms div 20000").alias("frame"), (F.col("event_id") % 3).alias("place"), F.concat(F.lit("item_"), (k % 5).cast("string")).alias("name")).agg(F.max(k / 100.0).alias("score"))
    return rows.withColumn("allowed", F.array(*map(F.lit, REWARD_NAMES)))


def _resolved(spark, folder):
    scores = _reward_scores(spark, folder)
    return ops.resolved_rewards(scores, time_order(scores, "chest", ("frame", "place")))


# every choice of different names is tried
@query("resolved_rewards", f"""
WITH {SIGNAL_SQL}, s AS (SELECT session_id AS chest, t_ms // 20000 AS frame, event_id % 3 AS place, k % 5 AS name, max(k) AS score FROM sig GROUP BY ALL),
f AS (SELECT DISTINCT chest, frame FROM s), p AS (SELECT DISTINCT chest, frame, place FROM s),
c AS (SELECT p.*, n.name, coalesce(s.score, -100) AS gain FROM p CROSS JOIN range(0, 4) n(name) LEFT JOIN s USING (chest, frame, place, name)),
u AS (SELECT chest, frame, a.name AS n0, b.name AS n1, d.name AS n2, coalesce(a.gain, 0) + coalesce(b.gain, 0) + coalesce(d.gain, 0) AS total
  FROM f LEFT JOIN (FROM c WHERE place = 0) a USING (chest, frame) LEFT JOIN (FROM c WHERE place = 1) b USING (chest, frame) LEFT JOIN (FROM c WHERE place = 2) d USING (chest, frame)
  WHERE coalesce(a.name <> b.name, TRUE) AND coalesce(a.name <> d.name, TRUE) AND coalesce(b.name <> d.name, TRUE)),
w AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY chest, frame ORDER BY total DESC, n0, n1, n2) = 1),
r AS (SELECT chest, frame, unnest([0, 1, 2]) AS place, unnest([n0, n1, n2]) AS name FROM w)
SELECT r.chest, r.frame, CAST(r.place AS BIGINT) AS place, 'item_' || r.name AS name, round(s.score / 100.0, 6) AS score,
  round(s.score / 100.0 - coalesce((SELECT max(o.score) FROM s o WHERE o.chest = r.chest AND o.frame = r.frame AND o.place = r.place AND o.name <> r.name), 0) / 100.0, 6) AS margin
FROM r LEFT JOIN s USING (chest, frame, place, name) WHERE r.name IS NOT NULL""")
def resolved_rewards(spark, folder):
    return _resolved(spark, folder).withColumns({name: F.round(name, 6) for name in ("score", "margin")})


@query("reward_consensus")
def reward_consensus(spark, folder):
    """Votes over the frames of a chest, each resolved one to one."""
    frames = _resolved(spark, folder).filter("score IS NOT NULL").withColumn("expected", F.lit(3))
    return ops.consensus_identities(frames, "chest").withColumns({name: F.round(name, 6) for name in ("score", "margin")})
