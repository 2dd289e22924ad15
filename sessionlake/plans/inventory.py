"""Inventory state, slots and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.operators import inventory as ops
from sessionlake.operators.ordering import running_sum, time_order
from sessionlake.operators.release import renumbered
from sessionlake.plans.registry import query
from sessionlake.sources.telemetry import SIGNAL_SQL, signals, table

_W = "PARTITION BY session_id ORDER BY t_ms, event_id"

_MENU_SQL = """
mn AS (SELECT session_id, event_id, t_ms - 400 - k AS start_ms, t_ms // 600 * 600 AS end_ms, 'item_' || (k % 2) AS candidate, 1 + k % 2 AS option_count, k % 50 AS cursor_score, k % 10 = 0 AS needs_review FROM sig WHERE event_type IN ('click', 'view') AND k % 50 >= 20),
ch AS (SELECT session_id, event_id, t_ms, 'item_' || (k % 2) AS item, k % 9 AS level, 8 AS max_level FROM sig WHERE event_type IN ('purchase', 'signup')),
mt AS (SELECT m.*, c.event_id AS change_id, c.item FROM mn m LEFT JOIN ch c ON c.session_id = m.session_id AND abs(c.t_ms - m.end_ms) <= 2500
   QUALIFY row_number() OVER (PARTITION BY m.session_id, m.event_id ORDER BY abs(c.t_ms - m.end_ms), c.t_ms, c.event_id) = 1),
ow AS (SELECT session_id, item, t_ms, max(level) AS level, max(max_level) AS mx FROM ch GROUP BY ALL),
mo AS (SELECT mt.*, ow.level AS ol, ow.mx AS om FROM mt ASOF LEFT JOIN ow ON ow.session_id = mt.session_id AND ow.item = mt.candidate AND mt.end_ms > ow.t_ms),
ml AS (SELECT *, lag(CASE WHEN change_id IS NOT NULL THEN item ELSE candidate END) OVER w AS pn, lag(option_count) OVER w AS pc, lag(end_ms) OVER w AS pe FROM mo WINDOW w AS (PARTITION BY session_id ORDER BY end_ms, event_id)),
mm AS (SELECT *, coalesce(change_id IS NULL AND pn = candidate AND pc = option_count AND start_ms - pe BETWEEN 0 AND 9000, FALSE) AS may FROM ml),
mr AS (SELECT *, sum(CASE WHEN may THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY end_ms, event_id) AS run FROM mm),
mb AS (SELECT *, first_value(change_id IS NOT NULL) OVER r AS ok, first_value(event_id) OVER r AS bid FROM mr WINDOW r AS (PARTITION BY session_id, run ORDER BY end_ms, event_id)),
mz AS (SELECT *, CASE WHEN may AND ok THEN bid ELSE event_id END AS owner FROM mb)"""


@query("level_up_transactions", f"""
WITH {SIGNAL_SQL}, {_MENU_SQL},
g AS (SELECT session_id, owner, max(end_ms) AS end_ms, count(*) AS menu_records FROM mz GROUP BY ALL)
SELECT g.session_id, g.owner AS event_id, start_ms, g.end_ms, CASE WHEN change_id IS NOT NULL THEN 'select_reward' WHEN option_count = 1 AND ol >= om THEN 'banish' ELSE 'unresolved_no_inventory_transition' END AS action,
  CASE WHEN change_id IS NOT NULL THEN CASE WHEN needs_review THEN 'C' ELSE 'A' END WHEN option_count = 1 AND ol >= om THEN 'B' ELSE 'unresolved' END AS evidence_grade, item AS item_name, change_id, menu_records
FROM g JOIN mz ON mz.session_id = g.session_id AND mz.event_id = g.owner""")
def level_up_transactions(spark, folder):
    rows = signals(spark, folder)
    k, t = F.col("k"), F.col("t_ms")
    name = F.concat(F.lit("item_"), (k % 2).cast("string"))
    menus = rows.filter("event_type IN ('click', 'view')").select(
        "session_id", "event_id", (t - 400 - k).alias("start_ms"), F.expr("t_ms div 600 * 600").alias("end_ms"), name.alias("candidate"),
        (1 + k % 2).alias("option_count"), (k % 50).alias("cursor_score"), (k % 10 == 0).alias("needs_review"))
    changes = rows.filter("event_type IN ('purchase', 'signup')").select("session_id", "event_id", "t_ms", name.alias("item"), (k % 9).alias("level"), F.lit(8).cast("long").alias("max_level"))
    return ops.level_up_transactions(menus, changes, tolerance_ms=2_500, continuation_ms=9_000)


@query("instant_rewards", f"""
WITH {SIGNAL_SQL}, m AS (SELECT session_id, event_id, CASE k % 5 WHEN 0 THEN ['Big Coin Bag', 'Floor Chicken'] WHEN 1 THEN ['Floor Chicken', 'Big Coin Bag'] WHEN 2 THEN ['Floor Chicken', 'Floor Chicken'] WHEN 3 THEN ['Big Coin Bag', 'Whip'] ELSE ['Big Coin Bag'] END AS labels,
  event_id % 3 AS selected FROM sig WHERE event_type = 'signup'),
r AS (SELECT session_id, event_id, labels[CAST(selected AS INT) + 1] AS reward FROM m WHERE len(labels) = 2 AND list_sort(labels) = ['Big Coin Bag', 'Floor Chicken'] AND selected < 2)
SELECT session_id, event_id, reward, 'level_up_transaction' AS event_type, 'menu_action' AS event_family, 'select_instant_reward' AS action FROM r
UNION ALL SELECT session_id, event_id, reward, CASE WHEN reward = 'Big Coin Bag' THEN 'big_coin_bag' ELSE 'floor_chicken' END, CASE WHEN reward = 'Big Coin Bag' THEN 'currency' ELSE 'consumable' END, 'acquired' FROM r""")
def instant_rewards(spark, folder):
    k = F.col("k") % 5
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    labels = (F.when(k == 0, names("Big Coin Bag", "Floor Chicken")).when(k == 1, names("Floor Chicken", "Big Coin Bag")).when(k == 2, names("Floor Chicken", "Floor Chicken"))
              .when(k == 3, names("Big Coin Bag", "Whip")).otherwise(names("Big Coin Bag")))
    rows = signals(spark, folder).filter("event_type = 'signup'").select("session_id", "event_id", labels.alias("labels"), (F.col("event_id") % 3).cast("int").alias("selected"))
    return ops.instant_rewards(rows, "labels", "selected", ("Big Coin Bag", "Floor Chicken")).drop("labels", "selected")


_SNAP_SQL = """
lv AS (SELECT l_suppkey AS session_id, l_orderkey AS snap, l_linenumber AS slot, max(1 + CAST(l_quantity AS BIGINT) % 3) AS level FROM lineitem GROUP BY ALL),
sn AS (SELECT session_id, snap, lead(snap) OVER w AS s1, lead(snap, 2) OVER w AS s2 FROM (SELECT DISTINCT session_id, snap FROM lv) WINDOW w AS (PARTITION BY session_id ORDER BY snap)),
gr AS (SELECT sn.session_id, sn.snap, s2, a.slot, a.level FROM sn JOIN lv a ON a.session_id = sn.session_id AND a.snap = sn.snap JOIN lv b ON b.session_id = sn.session_id AND b.snap = sn.s1 AND b.slot = a.slot AND b.level = a.level + 1),
o1 AS (SELECT session_id, snap, s2, any_value(slot) AS slot, any_value(level) AS level FROM gr GROUP BY ALL HAVING count(*) = 1)"""


def _snapshots(spark, folder):
    levels = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("session_id"), F.col("l_orderkey").alias("snap"), F.col("l_linenumber").alias("slot")).agg(
        F.max(1 + F.col("l_quantity").cast("long") % 3).alias("level"))
    return levels.groupBy("session_id", "snap").agg(F.map_from_entries(F.collect_list(F.struct("slot", "level"))).alias("levels"))


@query("retrospective_changes", f"WITH {_SNAP_SQL} SELECT session_id, snap, slot, level AS level_before, level + 1 AS level_after FROM o1")
def retrospective_changes(spark, folder):
    rows = _snapshots(spark, folder)
    return ops.snapshot_increase(rows, time_order(rows, by=("snap", "snap")), "levels").select("session_id", "snap", "slot", "level_before", "level_after")


@query("confirmed_upgrades", f"""
WITH {_SNAP_SQL} SELECT o1.session_id, o1.snap, o1.slot, o1.level AS level_before, o1.level + 1 AS level_after FROM o1 JOIN lv c ON c.session_id = o1.session_id AND c.snap = o1.s2 AND c.slot = o1.slot AND c.level >= o1.level + 1""")
def confirmed_upgrades(spark, folder):
    rows = _snapshots(spark, folder)
    return ops.snapshot_increase(rows, time_order(rows, by=("snap", "snap")), "levels", confirm=True).select("session_id", "snap", "slot", "level_before", "level_after")


SLOTS = range(1, 7)


def weapon_timeline(spark, folder):
    """Wide timeline: one row per sample with a name, a suggestion and a confidence per slot."""
    k = F.col("k")
    cols = []
    for slot in SLOTS:
        name = F.when((k + slot) % 4 == 0, "").otherwise(F.concat(F.lit("w"), (F.expr(f"(t_ms div 90000 + {slot}) % 5 + IF((k + {slot}) % 7 = 0, 1, 0)")).cast("string")))
        cols += [name.alias(f"weapon_{slot}"), F.concat(F.lit("s"), (k % 6).cast("string")).alias(f"suggested_weapon_{slot}"),
                 F.when(k % 3 == 0, "high").otherwise("medium").alias(f"confidence_{slot}")]
    return signals(spark, folder).select("session_id", "event_id", "t_ms", *cols)


def long_timeline(wide):
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"weapon_{s}").alias("weapon"), F.col(f"suggested_weapon_{s}").alias("suggested"),
                                         F.col(f"confidence_{s}").alias("confidence")) for s in SLOTS])).alias("x")
    return wide.select("session_id", "event_id", "t_ms", parts).select("session_id", "event_id", "t_ms", "x.*")


_SLOT_SQL = """
lt AS (SELECT session_id, event_id, t_ms, CAST(slot AS INT) AS slot, CASE WHEN (k + slot) % 4 = 0 THEN '' ELSE 'w' || ((t_ms // 90000 + slot) % 5 + CASE WHEN (k + slot) % 7 = 0 THEN 1 ELSE 0 END) END AS raw,
   's' || (k % 6) AS sug, CASE WHEN k % 3 = 0 THEN 'high' ELSE 'medium' END AS conf FROM sig, range(1, 7) AS r(slot)),
sa AS (SELECT *, lead(raw, 1) OVER w AS n1, lead(raw, 2) OVER w AS n2, count(*) OVER (PARTITION BY session_id, slot) AS n FROM lt WINDOW w AS (PARTITION BY session_id, slot ORDER BY t_ms, event_id)),
sb AS (SELECT *, raw <> '' AND (1 + CAST(coalesce(n1 = raw, FALSE) AS INT) + CAST(coalesce(n2 = raw, FALSE) AS INT) >= 2 OR (n = 1 AND conf = 'high')) AS backed FROM sa),
sc AS (SELECT *, last_value(CASE WHEN backed THEN raw END IGNORE NULLS) OVER (PARTITION BY session_id, slot ORDER BY t_ms, event_id) AS cur FROM sb),
sd2 AS (SELECT *, coalesce(raw <> '' AND raw = cur, FALSE) AS acc FROM sc),
se AS (SELECT *, last_value(CASE WHEN acc THEN sug END IGNORE NULLS) OVER w AS ks, last_value(CASE WHEN acc THEN conf END IGNORE NULLS) OVER w AS kc FROM sd2 WINDOW w AS (PARTITION BY session_id, slot ORDER BY t_ms, event_id)),
st AS (SELECT session_id, slot, event_id, t_ms, raw AS raw_weapon, coalesce(cur, '') AS weapon, coalesce(ks, '') AS suggested_weapon, coalesce(kc, 'empty') AS confidence, cur IS NOT NULL AND NOT acc AS carried FROM se)"""


def _stable(spark, folder):
    rows = long_timeline(weapon_timeline(spark, folder))
    return ops.stabilised_slots(rows, time_order(rows, ("session_id", "slot")), name="weapon", suggestion="suggested", confidence="confidence")


@query("slot_stabilise", f"WITH {SIGNAL_SQL}, {_SLOT_SQL} SELECT * FROM st")
def slot_stabilise(spark, folder):
    return _stable(spark, folder)


@query("slot_timeline_wide", f"""
WITH {SIGNAL_SQL}, {_SLOT_SQL}
SELECT session_id, event_id, {', '.join(f"max(weapon) FILTER (slot = {s}) AS weapon_{s}" for s in range(1, 7))}, count(*) FILTER (weapon <> '') AS weapon_count, count(*) FILTER (carried) AS carried_count FROM st GROUP BY ALL""")
def slot_timeline_wide(spark, folder):
    """Stabilised slots back in wide form, one row per sample."""
    d = _stable(spark, folder)
    return d.groupBy("session_id", "event_id").agg(
        *[F.max(F.when(F.col("slot") == s, F.col("weapon"))).alias(f"weapon_{s}") for s in SLOTS],
        F.count_if(F.col("weapon") != "").alias("weapon_count"), F.count_if("carried").alias("carried_count"))


@query("slot_events", f"""
WITH {SIGNAL_SQL}, {_SLOT_SQL}, l AS (SELECT *, lag(weapon) OVER (PARTITION BY session_id, slot ORDER BY t_ms, event_id) AS was FROM st)
SELECT session_id, slot, event_id, t_ms, CASE WHEN coalesce(was, '') = '' AND weapon <> '' THEN CASE WHEN was IS NULL THEN 'initial' ELSE 'acquired' END WHEN weapon = '' THEN 'removed' ELSE 'changed_or_evolved' END AS event,
  coalesce(was, '') AS previous_weapon, weapon FROM l WHERE weapon <> coalesce(was, '')""")
def slot_events(spark, folder):
    rows = _stable(spark, folder).select("session_id", "slot", "t_ms", "event_id", "weapon")
    return ops.slot_changes(rows, time_order(rows, ("session_id", "slot")), "weapon")


# fixed values: evolved weapon and the base it replaces
EVOLVED_FROM = {"w0": "w3", "w1": "w4", "w2": "w0", "w5": "w1"}


@query("set_replacements", f"""
WITH {SIGNAL_SQL}, {_SLOT_SQL}, ns AS (SELECT session_id, event_id, t_ms, list(DISTINCT raw) FILTER (raw <> '') AS names, list(raw ORDER BY slot) FILTER (raw <> '') AS shown FROM lt GROUP BY ALL),
l AS (SELECT *, lag(names) OVER ({_W}) AS was FROM ns),
e(after, before) AS (VALUES ('w0', 'w3'), ('w1', 'w4'), ('w2', 'w0'), ('w5', 'w1'))
SELECT session_id, e.after AS item_after, event_id, t_ms, e.before AS item_before, list_position(shown, e.after) AS slot FROM l JOIN e ON list_contains(names, e.after) AND NOT list_contains(was, e.after)
  AND list_contains(was, e.before) AND NOT list_contains(names, e.before) QUALIFY row_number() OVER (PARTITION BY session_id, e.after ORDER BY t_ms, event_id) = 1""")
def set_replacements(spark, folder):
    wide = weapon_timeline(spark, folder)
    rows = wide.select("session_id", "t_ms", "event_id", F.filter(F.array(*[F.col(f"weapon_{s}") for s in SLOTS]), lambda w: w != "").alias("names"))
    d = ops.replacements(rows, time_order(rows), "names", EVOLVED_FROM)
    return d.withColumn("slot", F.col("slot").cast("int"))


@query("progression_no_evolution", """
WITH p AS (SELECT l_suppkey AS session_id, l_partkey % 20 AS item, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 20 ORDER BY l_orderkey, l_linenumber) AS level FROM (SELECT DISTINCT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem))
SELECT session_id, item, l_orderkey, l_linenumber, CASE WHEN level = 1 THEN 'new' ELSE 'upgrade' END AS event_type, CASE WHEN level > 1 THEN level - 1 END AS level_before, level AS level_after, level > 8 AS needs_review FROM p""")
def progression_no_evolution(spark, folder):
    """Without evolutions the level of an item is its running count."""
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("session_id"), (F.col("l_partkey") % 20).alias("item"), "l_orderkey", "l_linenumber", "l_partkey").distinct()
    order = time_order(rows, ("session_id", "item"), ("l_orderkey", "l_linenumber"))
    d = order.untag(order.running(order.tag(rows), level=running_sum(F.lit(1).cast("long"))))
    level = F.col("level")
    return d.select("session_id", "item", "l_orderkey", "l_linenumber", F.when(level == 1, "new").otherwise("upgrade").alias("event_type"),
                    F.when(level > 1, level - 1).alias("level_before"), level.alias("level_after"), (level > 8).alias("needs_review"))


def _progress_rows(spark, folder):
    k, e = F.col("k"), F.col("event_id")
    item = lambda n: F.concat(F.lit("item_"), (k % n).cast("string"))
    return signals(spark, folder).filter("event_type IN ('click', 'purchase', 'signup')").select(
        "session_id", "event_id", "t_ms", F.when(k % 2 == 0, "weapon").otherwise("passive_item").alias("item_type"),
        F.when(F.col("t_ms") < 30_000, "initial_state").when(k % 12 == 0, "evolution").otherwise("upgrade").alias("change"),
        F.when(e % 5 == 0, "level_up_retrospective").otherwise("level_up").alias("source"), item(6).alias("item_before"), item(10).alias("item_after"), (k % 5).alias("configured_level"))


PROGRESS_MAXIMA = {f"item_{i}": 1 + i for i in range(10)}


# one row after the other over lists of held items, retired items and levels
@query("inventory_progression", f"""
WITH RECURSIVE {SIGNAL_SQL},
p AS (SELECT session_id, event_id, CASE WHEN k % 2 = 0 THEN 'weapon' ELSE 'passive_item' END AS kind, CASE WHEN t_ms < 30000 THEN 'initial_state' WHEN k % 12 = 0 THEN 'evolution' ELSE 'upgrade' END AS c,
  event_id % 5 = 0 AS retro, 'item_' || (k % 6) AS b, 'item_' || (k % 10) AS a, k % 5 AS cfg, 1 + k % 10 AS top, row_number() OVER (PARTITION BY session_id ORDER BY t_ms, event_id) AS i
  FROM sig WHERE event_type IN ('click', 'purchase', 'signup')),
r AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS VARCHAR) AS item_before, CAST(NULL AS VARCHAR) AS item_after,
    CAST(NULL AS BIGINT) AS level_before, CAST(NULL AS BIGINT) AS level_after, CAST(NULL AS BIGINT) AS top, CAST([] AS VARCHAR[]) AS held, CAST([] AS VARCHAR[]) AS gone, CAST([] AS STRUCT(x VARCHAR, n BIGINT)[]) AS lv
    FROM (SELECT DISTINCT session_id FROM p)
  UNION ALL SELECT session_id, i, event_id, kindof, CASE kindof WHEN 'evolution' THEN b WHEN 'upgrade' THEN a END, a, CASE kindof WHEN 'evolution' THEN lb WHEN 'upgrade' THEN coalesce(la, 1) END, after, top,
    CASE WHEN kindof IS NULL OR kindof = 'upgrade' THEN held WHEN kindof <> 'evolution' THEN list_append(held, ka)
      WHEN spot > 0 THEN list_concat(list_append(held[1:spot - 1], ka), held[spot + 1:]) WHEN list_contains(held, ka) THEN held ELSE list_append(held, ka) END,
    CASE WHEN kindof = 'evolution' THEN list_append(gone, b) ELSE gone END,
    CASE WHEN kindof IS NULL THEN lv ELSE list_append(list_filter(lv, lambda z: z.x <> a AND NOT (kindof = 'evolution' AND z.x = b)), {{'x': a, 'n': after}}) END
  FROM (SELECT *, CASE kindof WHEN 'evolution' THEN 1 WHEN 'upgrade' THEN coalesce(la, 1) + 1 WHEN 'initial_state' THEN greatest(1, cfg) ELSE 1 END AS after
    FROM (SELECT r.session_id, p.i, p.event_id, p.b, p.a, p.cfg, p.top, r.held, r.gone, r.lv, p.kind || p.a AS ka, coalesce(list_position(r.held, p.kind || p.b), 0) AS spot,
        list_filter(r.lv, lambda z: z.x = p.a)[1].n AS la, list_filter(r.lv, lambda z: z.x = p.b)[1].n AS lb,
        CASE WHEN p.retro AND list_contains(r.gone, p.a) THEN NULL WHEN p.c = 'evolution' THEN 'evolution' WHEN list_contains(r.held, p.kind || p.a) THEN 'upgrade' WHEN p.c = 'initial_state' THEN p.c ELSE 'new' END AS kindof
      FROM r JOIN p ON p.session_id = r.session_id AND p.i = r.i + 1)))
SELECT session_id, event_id, event_type, item_before, item_after, level_before, level_after, top AS normal_max_level, level_after > top AS needs_review,
  printf('inventory_event_%04d', row_number() OVER (PARTITION BY session_id ORDER BY i)) AS row_id FROM r WHERE event_type IS NOT NULL""")
def inventory_progression(spark, folder):
    rows = _progress_rows(spark, folder)
    return ops.progression(rows, time_order(rows), PROGRESS_MAXIMA)


def _menu_rows(spark, folder):
    """Choices of menus with the levels their snapshots show in five places; a session starts with two items at its baseline."""
    k, e = F.col("k"), F.col("event_id")
    level = lambda n: (F.expr("t_ms div 40000") + F.when((e * n) % 7 < 2, 1).otherwise(0)).cast("long")
    places = {"weapon:1": 3, "weapon:2": 5, "weapon:4": 2, "passive_item:1": 4, "passive_item:3": 6}
    snapshot = F.create_map(*(x for p, n in places.items() for x in (F.lit(p), level(n))))
    rows = signals(spark, folder).filter("event_type IN ('signup', 'click')").select(
        "session_id", "event_id", "t_ms", F.when(k % 2 == 0, "weapon").otherwise("passive_item").alias("item_type"), F.concat(F.lit("item_"), (k % 18).cast("string")).alias("item"),
        (e % 60).cast("double").alias("cursor_score"), (e % 3 == 0).alias("needs_review"), F.when(k % 18 % 4 != 0, 2 + k % 18 % 3).alias("max_level"), F.when(e % 11 != 0, snapshot).alias("snapshot"))
    sessions = signals(spark, folder).select("session_id").distinct()
    opening = sessions.select("session_id", F.explode(F.array(*(F.struct(F.lit(t).alias("item_type"), F.lit(1).alias("slot"), F.lit(i).alias("item")) for t, i in (("weapon", "item_0"), ("passive_item", "item_3"))))).alias("o"))
    return rows, opening.select("session_id", "o.*", F.lit(20_000).cast("long").alias("baseline_ms"))


# menus one after the other over the lists of owned items and their levels
@query("inventory_build", f"""
WITH RECURSIVE {SIGNAL_SQL},
m AS (SELECT session_id, event_id, t_ms, CASE WHEN k % 2 = 0 THEN 'weapon' ELSE 'passive_item' END AS kind, 'item_' || (k % 18) AS item, event_id % 60 AS cur, event_id % 3 = 0 AS rev,
  t_ms // 40000 AS q, CASE WHEN event_id % 11 <> 0 THEN event_id END AS s FROM sig WHERE event_type IN ('signup', 'click') AND t_ms > 20000),
l AS (SELECT *, lead(s) OVER w AS s1, lead(q) OVER w AS q1, lead(s, 2) OVER w AS s2, lead(q, 2) OVER w AS q2, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY session_id ORDER BY t_ms, event_id)),
x AS (SELECT *, list_filter(list_transform([('weapon', 1, 3), ('weapon', 2, 5), ('weapon', 4, 2), ('passive_item', 1, 4), ('passive_item', 3, 6)], lambda p: {{'kind': p[1], 'slot': p[2],
    'a': q + CASE WHEN s * p[3] % 7 < 2 THEN 1 ELSE 0 END + s * 0, 'b': q1 + CASE WHEN s1 * p[3] % 7 < 2 THEN 1 ELSE 0 END + s1 * 0, 'c': q2 + CASE WHEN s2 * p[3] % 7 < 2 THEN 1 ELSE 0 END + s2 * 0}}), lambda g: rev AND g.b = g.a + 1) AS grown FROM l),
caps AS (SELECT 'item_' || i AS item, CASE WHEN i % 4 <> 0 THEN 2 + i % 3 END AS cap FROM range(0, 18) r(i)),
r AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS item,
    CAST(NULL AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS lb, CAST(NULL AS BIGINT) AS la, CAST(['item_0'] AS VARCHAR[]) AS ws, CAST(['item_3'] AS VARCHAR[]) AS ps, CAST([{{'x': 'item_0', 'n': 1}}, {{'x': 'item_3', 'n': 1}}] AS STRUCT(x VARCHAR, n BIGINT)[]) AS lv
    FROM (SELECT DISTINCT session_id FROM sig)
  UNION ALL SELECT session_id, i, event_id, ev, CASE WHEN f1 OR f2 THEN 'level_up_retrospective' ELSE 'level_up' END, CASE WHEN ev = 'excluded' THEN reason END, tk, ti,
    CASE WHEN ev = 'excluded' THEN NULL WHEN f2 THEN tslot WHEN has THEN list_position(mine, ti) ELSE len(mine) + 1 END, CASE WHEN ev = 'upgrade' THEN cur_level END, CASE ev WHEN 'upgrade' THEN cur_level + 1 WHEN 'new' THEN 1 END,
    CASE WHEN ev = 'new' AND tk = 'weapon' THEN list_append(ws, ti) ELSE ws END, CASE WHEN ev = 'new' AND tk = 'passive_item' THEN list_append(ps, ti) ELSE ps END,
    CASE ev WHEN 'excluded' THEN lv ELSE list_append(list_filter(lv, lambda z: z.x <> ti), {{'x': ti, 'n': CASE ev WHEN 'upgrade' THEN cur_level + 1 ELSE 1 END}}) END
  FROM (SELECT *, list_filter(lv, lambda z: z.x = ti)[1].n AS cur_level, CASE WHEN f1 OR f2 THEN 'upgrade' WHEN reason IS NOT NULL THEN 'excluded' WHEN has THEN 'upgrade' ELSE 'new' END AS ev
    FROM (SELECT *, CASE WHEN f2 THEN cand[1].kind ELSE kind END AS tk, CASE WHEN f2 THEN CASE cand[1].kind WHEN 'weapon' THEN ws[cand[1].slot] ELSE ps[cand[1].slot] END ELSE item END AS ti, cand[1].slot AS tslot
      FROM (SELECT *, NOT f1 AND rev AND coalesce(reason, '') NOT IN ('item_already_at_normal_max', 'low_confidence_beyond_standard_slots') AND len(cand) = 1 AND coalesce(cand[1].c >= cand[1].b, FALSE) AS f2
        FROM (SELECT *, has AND len(own) = 1 AND (list_position(mine, item) > 6 OR own[1].slot = list_position(mine, item)) AS f1,
            CASE WHEN cur < 20 THEN 'selection_pointer_unconfirmed' WHEN has AND list_filter(lv, lambda z: z.x = item)[1].n >= cap THEN 'item_already_at_normal_max' WHEN NOT has AND len(mine) >= 6 AND rev THEN 'low_confidence_beyond_standard_slots' END AS reason
          FROM (SELECT *, list_contains(mine, item) AS has FROM (
            SELECT r.session_id, x.i, x.event_id, x.kind, x.item, x.cur, x.rev, r.ws, r.ps, r.lv, caps.cap, CASE x.kind WHEN 'weapon' THEN r.ws ELSE r.ps END AS mine,
              list_filter(x.grown, lambda g: g.kind = x.kind) AS own, list_filter(x.grown, lambda g: g.slot <= CASE g.kind WHEN 'weapon' THEN len(r.ws) ELSE len(r.ps) END) AS cand
            FROM r JOIN x ON x.session_id = r.session_id AND x.i = r.i + 1 JOIN caps ON caps.item = x.item)))))))
SELECT session_id, event_id, event_type, src AS event_source, reason AS exclusion_reason, kind AS item_type, item, slot, lb AS level_before, la AS level_after FROM r WHERE i > 0
UNION ALL SELECT session_id, NULL, 'initial_state', 'initial_state', NULL, o.kind, o.item, 1, NULL, 1 FROM (SELECT DISTINCT session_id FROM sig), (VALUES ('weapon', 'item_0'), ('passive_item', 'item_3')) o(kind, item)""")
def inventory_build(spark, folder):
    rows, opening = _menu_rows(spark, folder)
    return ops.inventory_build(rows, time_order(rows), opening)


@query("initial_levels", f"""
WITH {SIGNAL_SQL}, i AS (SELECT session_id, event_id, t_ms, event_type, k % 4 AS item, k % 9 AS lv FROM sig),
o AS (SELECT *, lv - (SELECT count(*) FROM i u WHERE u.event_type = 'purchase' AND u.session_id = i.session_id AND u.item = i.item AND u.t_ms < i.t_ms) AS inf FROM i WHERE event_type = 'view')
SELECT session_id, item, inf AS level_after FROM o WHERE inf >= 1 QUALIFY row_number() OVER (PARTITION BY session_id, item ORDER BY t_ms DESC, event_id DESC) = 1""")
def initial_levels(spark, folder):
    rows = signals(spark, folder).withColumn("item", F.col("k") % 4)
    seen = rows.filter("event_type = 'view'").select("session_id", "event_id", "t_ms", "item", (F.col("k") % 9).alias("observed_level"))
    upgrades = rows.filter("event_type = 'purchase'").select("session_id", "event_id", "t_ms", "item")
    return ops.inferred_initial_levels(seen, upgrades)


@query("chest_reward_merge", f"""
WITH {SIGNAL_SQL}, b AS (SELECT session_id, event_id, t_ms, CASE WHEN k % 5 = 0 THEN 'treasure_chest' ELSE 'level_up' END AS source, 'item_' || (k % 6) AS item FROM sig WHERE event_type = 'click'),
r AS (SELECT session_id, event_id, t_ms, 'treasure_chest' AS source, 'item_' || (k % 6) AS item FROM sig WHERE event_type = 'signup' AND k < 98),
x AS (SELECT DISTINCT session_id FROM sig WHERE event_type = 'signup' AND k >= 98),
u AS (SELECT * FROM b WHERE source <> 'treasure_chest' UNION ALL SELECT * FROM r)
SELECT session_id, event_id, source, item, printf('inv_%04d', row_number() OVER ({_W})) AS row_id FROM u WHERE session_id NOT IN (SELECT session_id FROM x)""")
def chest_reward_merge(spark, folder):
    """Guessed chest rows give way to accepted rewards (signups below 98); a session with any other, unaccepted one is refused as a whole."""
    rows = signals(spark, folder)
    item = F.concat(F.lit("item_"), (F.col("k") % 6).cast("string")).alias("item")
    guessed = rows.filter("event_type = 'click' AND k % 5 <> 0").select("session_id", "event_id", "t_ms", F.lit("level_up").alias("source"), item)
    accepted = rows.filter("event_type = 'signup' AND k < 98").select("session_id", "event_id", "t_ms", F.lit("treasure_chest").alias("source"), item)
    refused = rows.filter("event_type = 'signup' AND k >= 98").select("session_id").distinct()
    merged = guessed.unionByName(accepted).join(refused, "session_id", "left_anti")
    return renumbered(merged, time_order(merged), "inv", "row_id").select("session_id", "event_id", "source", "item", "row_id")


@query("reward_eligibility", f"""
WITH RECURSIVE {SIGNAL_SQL}, g AS (SELECT session_id, event_id, t_ms, k % 3 AS item, CASE WHEN k % 4 = 0 THEN k % 7 END AS rep, row_number() OVER (PARTITION BY session_id, k % 3 ORDER BY t_ms, event_id) AS i FROM sig WHERE event_type = 'purchase'),
s AS (SELECT session_id, item, t_ms, i, greatest(1, coalesce(rep, 0)) AS level FROM g WHERE i = 1
  UNION ALL SELECT g.session_id, g.item, g.t_ms, g.i, greatest(s.level + 1, coalesce(g.rep, 0)) FROM s JOIN g ON g.session_id = s.session_id AND g.item = s.item AND g.i = s.i + 1),
l AS (SELECT session_id, item, t_ms, max(level) AS level FROM s GROUP BY ALL),
c AS (SELECT c.session_id, c.event_id, c.t_ms, x.item FROM sig c JOIN (SELECT DISTINCT session_id, item FROM g) x ON x.session_id = c.session_id WHERE c.event_type = 'signup')
SELECT c.session_id, c.event_id, c.item, l.level, l.level < 6 AS upgradeable FROM c ASOF JOIN l ON l.session_id = c.session_id AND l.item = c.item AND c.t_ms > l.t_ms""")
def reward_eligibility(spark, folder):
    rows = signals(spark, folder)
    gains = rows.filter("event_type = 'purchase'").select("session_id", "event_id", "t_ms", (F.col("k") % 3).alias("item"), F.when(F.col("k") % 4 == 0, F.col("k") % 7).alias("reported_level"))
    chests = rows.filter("event_type = 'signup'").select("session_id", "event_id", "t_ms")
    return ops.reward_eligibility(chests, gains, maximum=F.lit(6)).select("session_id", "event_id", "item", "level", "upgradeable")


@query("identity_acceptance", f"""
WITH {SIGNAL_SQL}, o AS (SELECT event_id, (k % 50) / 50.0 AS score, (event_id % 10) / 100.0 AS margin, k % 6 AS votes, event_id % 7 AS frames, 1 + k % 3 AS rewards FROM sig WHERE event_type = 'signup'),
f AS (SELECT *, CASE WHEN frames > 0 THEN votes / frames ELSE 0 END AS vf FROM o)
SELECT event_id, round(vf, 6) AS vote_fraction, rewards > 1 AND score >= 0.35 AND votes >= 3 AND vf >= 0.60 AS stable_multi, (score >= 0.38 AND votes >= 2) OR (rewards > 1 AND score >= 0.35 AND votes >= 3 AND vf >= 0.60) AS accepted FROM f""")
def identity_acceptance(spark, folder):
    """The normal score gate, or for several rewards a weaker score that enough frames agree on."""
    k, e = F.col("k"), F.col("event_id")
    score, votes, frames, rewards = k % 50 / 50.0, k % 6, e % 7, 1 + k % 3
    fraction = F.when(frames > 0, votes / frames).otherwise(0.0)
    multi = (rewards > 1) & (score >= 0.35) & (votes >= 3) & (fraction >= 0.60)
    return signals(spark, folder).filter("event_type = 'signup'").select(
        "event_id", F.round(fraction, 6).alias("vote_fraction"), multi.alias("stable_multi"), (((score >= 0.38) & (votes >= 2)) | multi).alias("accepted"))
