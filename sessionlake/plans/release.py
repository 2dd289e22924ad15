"""Releases: canonical events, coverage, summaries and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.operators import release as ops
from sessionlake.operators.ordering import time_order
from sessionlake.operators.timejoin import first_containing
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import SIGNAL_SQL, signals

_EVO_SQL = """
ev AS (SELECT session_id, event_id, t_ms, k % 3 AS item, event_type = 'purchase' AS chest, CASE WHEN k < 20 THEN 'A' WHEN k < 50 THEN 'B' WHEN k < 80 THEN 'C' ELSE 'D' END AS evidence_grade,
  CASE WHEN k % 2 = 0 THEN 'auto_accepted' ELSE 'needs_review' END AS publication_status FROM sig WHERE event_type IN ('purchase', 'view')),
eg AS (SELECT *, CASE WHEN coalesce(t_ms - lag(t_ms) OVER w > 10000, TRUE) THEN 1 ELSE 0 END AS f FROM ev WINDOW w AS (PARTITION BY session_id, item ORDER BY t_ms, event_id)),
ec AS (SELECT *, sum(f) OVER (PARTITION BY session_id, item ORDER BY t_ms, event_id) AS cluster FROM eg),
ep AS (SELECT *, row_number() OVER (PARTITION BY session_id, item, cluster ORDER BY (NOT chest), t_ms, event_id) AS rn, min(evidence_grade) OVER c AS best, bool_or(publication_status = 'auto_accepted') OVER c AS ok,
  count(*) OVER c AS n FROM ec WINDOW c AS (PARTITION BY session_id, item, cluster))"""


def evolutions(spark, folder):
    k = F.col("k")
    return signals(spark, folder).filter("event_type IN ('purchase', 'view')").select(
        "session_id", "event_id", "t_ms", (k % 3).alias("item"), (F.col("event_type") == "purchase").alias("chest"),
        F.when(k < 20, "A").when(k < 50, "B").when(k < 80, "C").otherwise("D").alias("evidence_grade"),
        F.when(k % 2 == 0, "auto_accepted").otherwise("needs_review").alias("publication_status"))


@query("cluster_canonical", f"""
WITH {SIGNAL_SQL}, {_EVO_SQL}
SELECT session_id, item, event_id, t_ms, best AS evidence_grade, CASE WHEN ok THEN 'auto_accepted' ELSE 'needs_review' END AS publication_status, n AS evidence_count, n > 1 AS canonicalized FROM ep WHERE rn = 1""")
def cluster_canonical(spark, folder):
    return ops.canonical_clusters(ops.duplicate_clusters(evolutions(spark, folder), item="item"), item="item", from_chest="chest")


@query("cluster_members", f"""
WITH {SIGNAL_SQL}, {_EVO_SQL} SELECT session_id, item, CAST(cluster AS BIGINT) AS cluster, event_id FROM ec""")
def cluster_members(spark, folder):
    """Supporting events of every canonical event, one row each."""
    return ops.duplicate_clusters(evolutions(spark, folder), item="item").select("session_id", "item", "cluster", "event_id")


@query("evolution_parents", f"""
WITH {SIGNAL_SQL}, {_EVO_SQL}, b AS (SELECT session_id, event_id AS chest_id, t_ms AS s, t_ms + k * 120 AS e FROM sig WHERE event_type = 'click')
SELECT session_id, event_id, (SELECT chest_id FROM b WHERE b.session_id = ep.session_id AND ep.t_ms BETWEEN b.s AND b.e ORDER BY b.s, b.chest_id LIMIT 1) AS parent_chest_id FROM ep WHERE rn = 1""")
def evolution_parents(spark, folder):
    canonical = cluster_canonical(spark, folder).select("session_id", "event_id", "t_ms")
    chests = signals(spark, folder).filter("event_type = 'click'").select(
        "session_id", F.col("event_id").alias("parent_chest_id"), F.col("t_ms").alias("start_ms"), (F.col("t_ms") + F.col("k") * 120).alias("end_ms"))
    return first_containing(canonical, chests, ["parent_chest_id"], interval_tie="parent_chest_id").drop("t_ms")


def _lucky(spark, folder):
    rows = signals(spark, folder)
    k, t = F.col("k"), F.col("t_ms")
    lucky = rows.filter("event_type IN ('signup', 'view')").select("session_id", "event_id", (t - k * 20).alias("start_ms"), (t + k * 2).alias("end_ms"), t.alias("anchor_ms"))
    # menus close before the next one opens
    menus = rows.filter("event_type = 'click' AND k % 6 <> 0").select("session_id", "event_id", t.alias("anchor_ms"), t.alias("end_ms"), (t - k * 5).alias("_s"))
    order = time_order(menus, "session_id", ("anchor_ms", "event_id"))
    menus = order.untag(order.frames(order.tag(menus), 1, _p=lambda w: F.lag("anchor_ms").over(w)))
    transactions = menus.select("session_id", "event_id", "anchor_ms", "end_ms", F.greatest("_s", F.coalesce("_p", F.lit(-1_000_000))).alias("start_ms"))
    return ops.match_to_transactions(lucky, transactions)


_LUCKY_SQL = """
lk AS (SELECT session_id, event_id, t_ms - k * 20 AS s, t_ms + k * 2 AS e, t_ms AS a FROM sig WHERE event_type IN ('signup', 'view')),
tr AS (SELECT session_id, event_id AS tid, t_ms AS ta, greatest(t_ms - k * 5, coalesce(lag(t_ms) OVER (PARTITION BY session_id ORDER BY t_ms, event_id), -1000000)) AS ts FROM sig WHERE event_type = 'click' AND k % 6 <> 0),
lm AS (SELECT lk.*, tid, ta FROM lk LEFT JOIN tr ON tr.session_id = lk.session_id AND (abs(ta - a) <= 50 OR (s <= ta AND e >= ts))
   QUALIFY row_number() OVER (PARTITION BY lk.session_id, lk.event_id ORDER BY abs(ta - a), ta, tid) = 1)"""


@query("lucky_matches", f"WITH {SIGNAL_SQL}, {_LUCKY_SQL} SELECT session_id, event_id, tid AS transaction_id, ta AS transaction_ms FROM lm")
def lucky_matches(spark, folder):
    return _lucky(spark, folder).select("session_id", "event_id", "transaction_id", "transaction_ms")


@query("lucky_canonical")
def lucky_canonical(spark, folder):
    return ops.canonical_lucky(ops.lucky_support(_lucky(spark, folder)))


@query("last_wins", f"""
WITH {SIGNAL_SQL}, u AS (SELECT 1 AS source, event_id % 4000 AS id, event_id, event_type, t_ms FROM sig WHERE event_type IN ('click', 'view') UNION ALL SELECT 2, event_id % 4000, event_id, event_type, t_ms FROM sig WHERE event_type = 'purchase')
SELECT source, id, event_id, event_type, t_ms FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY source DESC, event_id DESC) = 1""")
def last_wins(spark, folder):
    rows = signals(spark, folder).filter("event_type IN ('click', 'view', 'purchase')").select(
        F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("source"), (F.col("event_id") % 4000).alias("id"), "event_id", "event_type", "t_ms")
    return ops.last_wins(rows, ["id"], ["source", "event_id"])


_REL_SQL = """
rl AS (SELECT session_id, event_id, event_type, CASE WHEN k < 60 THEN 'auto_accepted' WHEN k < 90 THEN 'needs_review' ELSE 'unresolved' END AS publication_status FROM sig)"""


def release_events(spark, folder):
    k = F.col("k")
    return signals(spark, folder).select("session_id", "event_id", "event_type", "t_ms", F.when(k < 60, "auto_accepted").when(k < 90, "needs_review").otherwise("unresolved").alias("publication_status"))


@query("release_summary", f"""
WITH {SIGNAL_SQL}, {_REL_SQL} SELECT session_id, count(*) AS event_count, count(*) FILTER (publication_status = 'auto_accepted') AS accepted_count, count(*) FILTER (publication_status <> 'auto_accepted') AS review_count
FROM rl WHERE publication_status <> 'unresolved' GROUP BY ALL""")
def release_summary(spark, folder):
    """Unresolved source rows are not published."""
    return ops.release_summary(release_events(spark, folder).filter("publication_status <> 'unresolved'"), ["session_id"])


@query("release_coverage", f"""
WITH {SIGNAL_SQL}, {_REL_SQL} SELECT event_type, 'events_published' AS status, count(*) AS published_count, CASE WHEN event_type = 'click' THEN 'Exact automated pickup events.' END AS note FROM rl WHERE publication_status <> 'unresolved' GROUP BY event_type""")
def release_coverage(spark, folder):
    return release_events(spark, folder).filter("publication_status <> 'unresolved'").groupBy("event_type").agg(
        F.lit("events_published").alias("status"), F.count(F.lit(1)).alias("published_count")).withColumn(
        "note", F.when(F.col("event_type") == "click", "Exact automated pickup events."))


@query("summary_counters", f"""
WITH {SIGNAL_SQL}, {_REL_SQL} SELECT event_type, publication_status, count(*) AS n FROM rl GROUP BY ALL""")
def summary_counters(spark, folder):
    return release_events(spark, folder).groupBy("event_type", "publication_status").agg(F.count(F.lit(1)).alias("n"))


@query("run_audit", f"""
WITH {SIGNAL_SQL}, f AS (SELECT session_id, count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors_seen, max(t_ms) AS last_ms, count(DISTINCT event_type) AS kinds FROM sig GROUP BY ALL),
e AS (SELECT *, concat_ws('|', CASE WHEN NOT (kinds = 5) THEN 'all_kinds_present' END, CASE WHEN NOT (last_ms >= 700000) THEN 'covers_recording' END, CASE WHEN NOT (errors_seen * 4 <= rows) THEN 'error_share_within_limit' END, CASE WHEN NOT (rows >= 60) THEN 'enough_rows' END) AS errors FROM f)
SELECT session_id, rows, errors_seen, last_ms, kinds, concat_ws('|', CASE WHEN kinds <> 5 THEN 'all_kinds_present' END, CASE WHEN last_ms < 700000 THEN 'covers_recording' END, CASE WHEN rows < 60 THEN 'enough_rows' END,
  CASE WHEN errors_seen * 4 > rows THEN 'error_share_within_limit' END) AS errors, CASE WHEN errors = '' THEN 'passed' ELSE 'failed' END AS status FROM e""")
def run_audit(spark, folder):
    facts = signals(spark, folder).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("event_type") == "error").alias("errors_seen"), F.max("t_ms").alias("last_ms"),
        F.count_distinct("event_type").alias("kinds"))
    return ops.audit(facts, all_kinds_present=F.col("kinds") == 5, covers_recording=F.col("last_ms") >= 700_000, enough_rows=F.col("rows") >= 60,
                     error_share_within_limit=F.col("errors_seen") * 4 <= F.col("rows"))


@query("detector_summary", f"""
WITH {SIGNAL_SQL} SELECT count(*) AS events, count(*) FILTER (event_type = 'click') AS blue_events, count(*) FILTER (event_type = 'view') AS green_events, count(*) FILTER (k >= 95) AS saturated_events,
  count(*) FILTER (k < 10) AS review_events, min(value) AS gain_min, max(value) AS gain_max, round(avg(value), 4) AS gain_mean, CAST(sum(k) AS BIGINT) AS quantity, count(*) FILTER (event_id % 7 = 0) AS fallback_levels,
  round(count(*) FILTER (k < 10) / count(*), 6) AS review_fraction, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM sig""")
def detector_summary(spark, folder):
    k = F.col("k")
    return signals(spark, folder).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "click").alias("blue_events"), F.count_if(F.col("event_type") == "view").alias("green_events"),
        F.count_if(k >= 95).alias("saturated_events"), F.count_if(k < 10).alias("review_events"), F.min("value").alias("gain_min"), F.max("value").alias("gain_max"),
        F.round(F.avg("value"), 4).alias("gain_mean"), F.sum("k").alias("quantity"), F.count_if(F.col("event_id") % 7 == 0).alias("fallback_levels"),
        F.round(F.count_if(k < 10) / F.count(F.lit(1)), 6).alias("review_fraction"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))
