"""Source checks, manifests, sampling plans and export slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.operators.counters import corroborated
from sessionlake.operators.ordering import running_sum, time_order
from sessionlake.plans.registry import query
from sessionlake.sources import files as ops
from sessionlake.sources.telemetry import SESSION_DURATION_MS, SIGNAL_SQL, signals, table


@query("frame_decimation", f"""
WITH {SIGNAL_SQL}, f AS (SELECT session_id, event_id, t_ms, row_number() OVER (PARTITION BY session_id ORDER BY t_ms, event_id) AS frame FROM sig),
b AS (SELECT *, CAST(floor((t_ms + 0.5 - 30000) / 15000) AS BIGINT) AS slot FROM f)
SELECT session_id, event_id, t_ms, frame FROM b WHERE slot >= 0 QUALIFY row_number() OVER (PARTITION BY session_id, slot ORDER BY frame) = 1""")
def frame_decimation(spark, folder):
    rows = signals(spark, folder).select("session_id", "event_id", "t_ms")
    order = time_order(rows)
    frames = order.untag(order.running(order.tag(rows), frame=running_sum(F.lit(1).cast("long"))))
    return ops.decimated(frames, period_ms=15_000, start_ms=30_000)


@query("export_page", f"""
WITH {SIGNAL_SQL} SELECT event_id, session_id, t_ms FROM sig ORDER BY session_id, t_ms, event_id LIMIT 50 OFFSET 100""")
def export_page(spark, folder):
    """One page of an ordered review export."""
    rows = signals(spark, folder).select("event_id", "session_id", "t_ms")
    return ops.page(rows, ["session_id", "t_ms", "event_id"], 100, 50)


_CONFIG_SQL = """
cf AS (SELECT p_partkey AS config, 'video_' || (p_partkey % 700) AS source, sha256('v' || (p_partkey % 900)) AS sha256 FROM part),
so AS (SELECT 'video_' || (l_orderkey % 800) AS source, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE sha256('v' || (l_orderkey % 800 + CASE WHEN l_orderkey % 13 = 0 THEN 50 ELSE 0 END)) END AS sha256, l_orderkey % 9 <> 0 AS inspected FROM (SELECT DISTINCT l_orderkey FROM lineitem))"""


def _registry(spark, folder):
    configs = table(spark, folder, "part").select(F.col("p_partkey").alias("config"), F.concat(F.lit("video_"), (F.col("p_partkey") % 700).cast("string")).alias("source"),
                                                  F.sha2(F.concat(F.lit("v"), (F.col("p_partkey") % 900).cast("string")), 256).alias("sha256"))
    k = F.col("l_orderkey")
    sources = table(spark, folder, "lineitem").select("l_orderkey").distinct().select(
        F.concat(F.lit("video_"), (k % 800).cast("string")).alias("source"),
        F.when(k % 9 != 0, F.sha2(F.concat(F.lit("v"), (k % 800 + F.when(k % 13 == 0, 50).otherwise(0)).cast("string")), 256)).alias("sha256"), (k % 9 != 0).alias("inspected"))
    return configs, sources


@query("source_registry", f"""
WITH {_CONFIG_SQL}, h AS (SELECT sha256, count(*) AS m, min(source) AS o FROM so WHERE sha256 IS NOT NULL GROUP BY ALL), n AS (SELECT source, bool_or(NOT inspected) AS failed FROM so GROUP BY ALL), x AS (SELECT DISTINCT source, sha256 FROM so)
SELECT config, CASE WHEN x.source IS NOT NULL THEN 'verified' WHEN m = 1 THEN 'verified_renamed_source' WHEN m > 1 THEN 'ambiguous_duplicate_sources' WHEN failed THEN 'configured_source_inspection_failed' WHEN failed IS NOT NULL THEN 'configured_source_hash_mismatch' ELSE 'source_missing' END AS identity_status,
  CASE WHEN x.source IS NOT NULL THEN cf.source WHEN m = 1 THEN o END AS resolved_source, coalesce(m, 0) AS matching_sources FROM cf LEFT JOIN h ON h.sha256 = cf.sha256 LEFT JOIN n ON n.source = cf.source LEFT JOIN x ON x.source = cf.source AND x.sha256 = cf.sha256""")
def source_registry(spark, folder):
    return ops.resolve_configurations(*_registry(spark, folder))


@query("unconfigured_sources", f"WITH {_CONFIG_SQL} SELECT source FROM so WHERE NOT EXISTS (SELECT 1 FROM cf WHERE cf.sha256 = so.sha256)")
def unconfigured_sources(spark, folder):
    return ops.unconfigured(*_registry(spark, folder))


@query("run_manifest", f"""
WITH {SIGNAL_SQL} SELECT session_id, count(*) AS canonical_events, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (k < 60) AS auto_accepted, count(*) FILTER (k >= 60) AS needs_review, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM sig GROUP BY ALL""")
def run_manifest(spark, folder):
    kind, k = F.col("event_type"), F.col("k")
    return signals(spark, folder).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("canonical_events"), F.count_if(kind == "click").alias("click"), F.count_if(kind == "view").alias("view"), F.count_if(k < 60).alias("auto_accepted"),
        F.count_if(k >= 60).alias("needs_review"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))


def _text_sql(*names: str) -> str:
    return " || ".join(f"coalesce(strlen(CAST({n} AS VARCHAR)) || ':' || {n}, '-')" for n in sorted(names))


@query("table_fingerprints", f"""
WITH {SIGNAL_SQL}, h AS (SELECT session_id, CAST('0x' || substr(sha256({_text_sql('session_id', 'event_id', 't_ms', 'event_type', 'cents', 'k')}), 1, 15) AS BIGINT) AS h FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM sig))
SELECT session_id, count(*) AS rows, CAST(sum(h) AS VARCHAR) AS fingerprint FROM h GROUP BY session_id""")
def table_fingerprints(spark, folder):
    """Order-insensitive content fingerprint per session."""
    rows = signals(spark, folder).withColumn("cents", F.round(F.col("value") * 100).cast("long")).drop("value")
    return ops.table_fingerprint(rows, ["session_id"])


@query("manifest_verification", f"""
WITH {SIGNAL_SQL}, a AS (SELECT session_id, count(*) AS n FROM sig WHERE session_id % 10 <> 0 GROUP BY ALL), m AS (SELECT session_id, count(*) AS n FROM sig GROUP BY ALL),
c AS (SELECT DISTINCT session_id FROM sig WHERE event_id % 501 = 0)
SELECT m.session_id, CASE WHEN a.n IS NULL THEN 'missing' ELSE 'content_differs' END AS problem FROM m LEFT JOIN a USING (session_id) LEFT JOIN c ON c.session_id = m.session_id WHERE a.n IS NULL OR c.session_id IS NOT NULL""")
def manifest_verification(spark, folder):
    rows = signals(spark, folder).select("session_id", "event_id", "event_type")
    manifest = ops.table_fingerprint(rows, ["session_id"])
    stored = rows.filter("session_id % 10 <> 0").withColumn("event_type", F.when(F.col("event_id") % 501 == 0, "other").otherwise(F.col("event_type")))
    return ops.verified(manifest, ops.table_fingerprint(stored, ["session_id"]), ["session_id"])


@query("unconfirmed_empty_runs", f"""
WITH {SIGNAL_SQL}, p AS (SELECT DISTINCT session_id FROM sig WHERE event_type = 'click' AND k >= 85), s AS (SELECT session_id, CASE WHEN min(event_id) % 3 = 0 THEN 0 WHEN min(event_id) % 3 = 1 THEN NULL ELSE 4 END AS n FROM sig GROUP BY ALL)
SELECT session_id FROM s WHERE session_id NOT IN (SELECT session_id FROM p) AND n IS DISTINCT FROM 0""")
def unconfirmed_empty_runs(spark, folder):
    """Runs without events must say so in their summary."""
    rows = signals(spark, folder)
    first = F.min("event_id") % 3
    summaries = rows.groupBy("session_id").agg(F.when(first == 0, 0).when(first == 2, 4).alias("xp_jump_events"))
    return ops.confirmed_empty(rows.filter("event_type = 'click' AND k >= 85"), summaries, "session_id")


@query("sample_plan", f"""
WITH {SIGNAL_SQL}, r AS (SELECT session_id, max(t_ms) // 1000 AS d, min(t_ms) // 1000 AS o FROM sig GROUP BY ALL),
x AS (SELECT session_id, d, unnest([0, 60, 300, 600, 715, o + 5, o + 60]) AS second FROM r) SELECT DISTINCT session_id, second FROM x WHERE second >= 0 AND second < d""")
def sample_plan(spark, folder):
    recordings = signals(spark, folder).groupBy("session_id").agg(F.expr("max(t_ms) div 1000").alias("d"), F.expr("min(t_ms) div 1000").alias("o"))
    return ops.sample_plan(recordings, (0, 60, 300, 600, 715), duration="d", onset="o", relative=(5, 60)).select("session_id", "second")


@query("shared_source_guard", f"""
WITH {SIGNAL_SQL}, h AS (SELECT DISTINCT session_id, session_id % 4 AS asset FROM sig WHERE event_type = 'error'), i AS (SELECT DISTINCT session_id, CASE WHEN session_id % 17 = 0 THEN 9 ELSE session_id % 4 END AS asset FROM sig WHERE event_type = 'purchase')
SELECT session_id, asset FROM h WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.session_id = h.session_id AND i.asset = h.asset)""")
def shared_source_guard(spark, folder):
    """Sessions whose two inputs do not come from the same asset and so may not be joined."""
    rows = signals(spark, folder)
    health = rows.filter("event_type = 'error'").select("session_id", (F.col("session_id") % 4).alias("asset")).distinct()
    items = rows.filter("event_type = 'purchase'").select("session_id", F.when(F.col("session_id") % 17 == 0, 9).otherwise(F.col("session_id") % 4).cast("long").alias("asset")).distinct()
    return health.join(items, ["session_id", "asset"], "left_anti")


@query("renormalisation_matches", f"""
WITH {_CONFIG_SQL}, r AS (SELECT o_orderkey AS run, sha256('v' || (o_orderkey % 1000)) AS sha256 FROM orders), n AS (SELECT sha256, count(*) AS m, min(config) AS config FROM cf GROUP BY ALL)
SELECT run, coalesce(m, 0) AS configurations, CASE WHEN m = 1 THEN config END AS config, coalesce(m, 0) = 1 AS usable FROM r LEFT JOIN n USING (sha256)""")
def renormalisation_matches(spark, folder):
    """Stored runs and the one configuration they must match by content hash."""
    configs, _ = _registry(spark, folder)
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run"), F.sha2(F.concat(F.lit("v"), (F.col("o_orderkey") % 1000).cast("string")), 256).alias("sha256"))
    known = configs.groupBy("sha256").agg(F.count(F.lit(1)).alias("m"), F.min("config").alias("config"))
    d = runs.join(known, "sha256", "left").withColumn("configurations", F.coalesce("m", F.lit(0)).cast("long"))
    return d.select("run", "configurations", F.when(F.col("m") == 1, F.col("config")).alias("config"), (F.col("configurations") == 1).alias("usable"))


# fixed values: parts of one published series
SERIES = [(0, 0, 0, 240_000), (1, 0, 240_000, 480_000), (2, 1_000, 480_000, 720_000)]


@query("gold_series_points", f"""
WITH {SIGNAL_SQL}, p(part, off, s, e) AS (VALUES (0, 0, 0, 240000), (1, 0, 240000, 480000), (2, 1000, 480000, 720000)),
o AS (SELECT session_id, event_id, part, t_ms + off AS t_ms, k % 4 AS value, event_id % 19 = 0 AS fever FROM sig JOIN p ON t_ms // 240000 = part WHERE event_type <> 'error' AND t_ms + off >= s AND t_ms + off < e),
l AS (SELECT *, lag(value) OVER w AS pv, lag(t_ms) OVER w AS pt, lead(value) OVER w AS nv, lead(t_ms) OVER w AS nt FROM o WHERE NOT fever WINDOW w AS (PARTITION BY session_id, part ORDER BY t_ms, event_id))
SELECT session_id, event_id, part, t_ms, value, 'repeat' AS validation FROM l WHERE (pv = value AND t_ms - pt <= 8000) OR (nv = value AND nt - t_ms <= 8000)
UNION ALL SELECT session_id, event_id, part, t_ms, value, 'gold_fever_monotonic_confirmation' FROM o WHERE fever""")
def gold_series_points(spark, folder):
    """Published counter points of a multi-part series: shift, window, then corroborate what is not already confirmed."""
    parts = spark.createDataFrame(SERIES, "part long, off long, s long, e long")
    rows = signals(spark, folder).filter("event_type <> 'error'").withColumn("part", F.expr("t_ms div 240000")).join(F.broadcast(parts), "part")
    rows = rows.withColumn("t_ms", F.col("t_ms") + F.col("off")).filter("t_ms >= s AND t_ms < e").select(
        "session_id", "part", "event_id", "t_ms", (F.col("k") % 4).alias("value"), (F.col("event_id") % 19 == 0).alias("fever"))
    plain = rows.filter("NOT fever").drop("fever")
    kept = corroborated(plain, time_order(plain, ("session_id", "part")), "value", 8_000)
    confirmed = rows.filter("fever").drop("fever")
    return kept.withColumn("validation", F.lit("repeat")).unionByName(confirmed.withColumn("validation", F.lit("gold_fever_monotonic_confirmation")))
