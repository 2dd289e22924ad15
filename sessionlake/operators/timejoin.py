"""Joins of event streams in time.

Each join is a sorted union of both sides plus a running "last seen" (or "next seen") over the session.
No pairs are ever emitted, so the cost is one shuffle of both sides however dense the data is, and large
sessions are split by :mod:`sessionlake.operators.ordering`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.operators.ordering import Running, TimeOrder, last_seen, next_seen, time_order

_SIDE_STEP = 1 << 61


def merged_streams(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: Column, right_time: Column,
                   left_tie: Column, right_tie: Column, right_first: bool = True) -> tuple[DataFrame, TimeOrder]:
    """Both sides as rows ``(keys, _t, _seq, _left, _right)``; ``right_first`` orders equal times."""
    right_side, left_side = (0, 1) if right_first else (1, 0)
    lefts = left.select(*keys, left_time.cast("long").alias("_t"),
                        (F.lit(left_side * _SIDE_STEP) + left_tie.cast("long")).alias("_seq"),
                        F.struct(*left.columns).alias("_left"))
    rights = right.select(*keys, right_time.cast("long").alias("_t"),
                          (F.lit(right_side * _SIDE_STEP) + right_tie.cast("long")).alias("_seq"),
                          F.struct(*right.columns).alias("_right"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    return both, time_order(both, keys, ("_t", "_seq"))


def stream_join(left: DataFrame, right: DataFrame, specs: dict[str, Running], *, keys: Sequence[str] = ("session_id",),
                left_time: str = "t_ms", right_time: str = "t_ms", left_tie: str = "event_id",
                right_tie: str = "event_id", right_first: bool = True) -> DataFrame:
    """Left rows with running aggregates over the right rows; expressions address ``_right.<column>``."""
    both, order = merged_streams(left, right, keys, F.col(left_time), F.col(right_time),
                                 F.col(left_tie), F.col(right_tie), right_first)
    out = order.running(order.tag(both), **specs)
    return out.filter(F.col("_left").isNotNull()).select("_left.*", *specs)


def asof(left: DataFrame, right: DataFrame, payload: Sequence[str], *, prefix: str = "", strict: bool = False,
         forward: bool = False, **names) -> DataFrame:
    """Latest right row at or before (``strict``: before) the left time, or the earliest at or after it."""
    value = F.when(F.col("_right").isNotNull(), F.struct(*[F.col(f"_right.{name}") for name in payload]))
    spec = next_seen(value) if forward else last_seen(value)
    right_first = strict if forward else not strict
    out = stream_join(left, right, {"_match": spec}, right_first=right_first, **names)
    return out.select("*", *[F.col(f"_match.{name}").alias(f"{prefix}{name}") for name in payload]).drop("_match")


def nearest(left: DataFrame, right: DataFrame, payload: Sequence[str], tolerance_ms: int, *, prefix: str = "",
            keys: Sequence[str] = ("session_id",), left_time: str = "t_ms", right_time: str = "t_ms",
            left_tie: str = "event_id", right_tie: str = "event_id", distance: str = "distance_ms") -> DataFrame:
    """Closest right row within the tolerance; the earlier one wins a tie, then the smaller tie-breaker.

    The closest row is the last one before or the first one after, so two running values are enough.
    Right rows that share an instant are reduced to one beforehand.
    """
    single = right.groupBy(*keys, right_time).agg(
        F.min_by(F.struct(*right.columns), F.col(right_tie)).alias("_r")).select("_r.*")
    fields = list(dict.fromkeys([*payload, right_time]))
    value = F.when(F.col("_right").isNotNull(), F.struct(*[F.col(f"_right.{name}") for name in fields]))
    out = stream_join(left, single, {"_before": last_seen(value), "_after": next_seen(value)}, keys=keys,
                      left_time=left_time, right_time=right_time, left_tie=left_tie, right_tie=right_tie)
    back = F.col(left_time) - F.col(f"_before.{right_time}")
    ahead = F.col(f"_after.{right_time}") - F.col(left_time)
    use_back = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    chosen = F.when(use_back, F.col("_before")).otherwise(F.col("_after"))
    gap = F.when(use_back, back).otherwise(ahead)
    out = out.withColumns({"_hit": F.when(gap <= tolerance_ms, chosen), distance: F.when(gap <= tolerance_ms, gap)})
    return out.select(*left.columns, *[F.col(f"_hit.{name}").alias(f"{prefix}{name}") for name in payload], distance)


def inside_any(points: DataFrame, intervals: DataFrame, *, start: str = "start_ms", end: str = "end_ms",
               time: str = "t_ms", keys: Sequence[str] = ("session_id",), tie: str = "event_id",
               interval_tie: str | None = None, open_start: bool = True, name: str = "inside") -> DataFrame:
    """Flag points that lie in some interval: compare with the largest end among intervals started so far."""
    marked = intervals.withColumn("_no", F.col(interval_tie) if interval_tie else F.lit(0))
    out = stream_join(points, marked, {"_reach": Running("max", F.col(f"_right.{end}"))}, keys=keys, left_time=time,
                      right_time=start, left_tie=tie, right_tie="_no", right_first=not open_start)
    return out.withColumn(name, F.coalesce(F.col("_reach") > F.col(time), F.lit(False))).drop("_reach")


def containing(points: DataFrame, intervals: DataFrame, payload: Sequence[str], *, start: str = "start_ms",
               end: str = "end_ms", end_closed: bool = False, time: str = "t_ms",
               keys: Sequence[str] = ("session_id",), tie: str = "event_id", interval_tie: str,
               prefix: str = "") -> DataFrame:
    """The interval around each point, for intervals that do not overlap one another."""
    fields = list(dict.fromkeys([*payload, end]))
    out = asof(points, intervals, fields, prefix="_c_", keys=keys, left_time=time, right_time=start,
               left_tie=tie, right_tie=interval_tie)
    reach = F.col(f"_c_{end}")
    within = reach >= F.col(time) if end_closed else reach > F.col(time)
    return out.select(*points.columns, *[F.when(within, F.col(f"_c_{name}")).alias(f"{prefix}{name}") for name in payload])


def first_containing(points: DataFrame, intervals: DataFrame, payload: Sequence[str], *, start: str = "start_ms",
                     end: str = "end_ms", time: str = "t_ms", keys: Sequence[str] = ("session_id",), tie: str = "event_id",
                     interval_tie: str = "event_id", prefix: str = "") -> DataFrame:
    """Earliest-starting interval that contains each point, both ends included; intervals may overlap.

    An interval that ends no later than an earlier one can never be the earliest to contain a point.  The others
    have increasing ends, so the answer is the first of them that ends at or after the point, if it has started.
    """
    order = time_order(intervals, keys, (start, interval_tie))
    d = order.running(order.tag(intervals), _reach=Running("max", F.col(end), exclusive=True))
    leading = order.untag(d.filter(F.col("_reach").isNull() | (F.col(end) > F.col("_reach")))).drop("_reach")
    fields = list(dict.fromkeys([*payload, start]))
    out = asof(points, leading, fields, prefix="_c_", forward=True, keys=keys, left_time=time, right_time=end,
               left_tie=tie, right_tie=interval_tie)
    within = F.col(f"_c_{start}") <= F.col(time)
    return out.select(*points.columns, *[F.when(within, F.col(f"_c_{name}")).alias(f"{prefix}{name}") for name in payload])


def unique_nearest(points: DataFrame, targets: DataFrame, *, time: str, low: Column, high: Column, margin: int,
                   keys: Sequence[str] = ("session_id",), tie: str = "event_id", target_time: str = "t_ms",
                   target_tie: str = "event_id") -> DataFrame:
    """Closest target in ``[low, high]`` for each point, unless a second one is closer than ``margin`` to it.

    Adds ``match_time``, ``match_id`` and ``outcome`` (``assigned``, ``ambiguous`` or ``none``).  The two closest are
    among the two targets on either side, which every target carries along.
    """
    single = targets.groupBy(*keys, target_time).agg(F.min(target_tie).alias("_id"), F.count(F.lit(1)).alias("_n"))
    order = time_order(single, keys, (target_time, "_id"))
    pack = F.struct(F.col(target_time).alias("t"), F.col("_id").alias("id"), F.col("_n").alias("n"))
    single = order.untag(order.frames(order.tag(single.withColumn("_me", pack)), 1, _older=lambda w: F.lag("_me").over(w),
                                      _newer=lambda w: F.lead("_me").over(w)))
    common = dict(keys=keys, left_time=time, right_time=target_time, left_tie=tie, right_tie="_id")
    marked = points.withColumns({"_low": low, "_high": high})
    d = asof(marked, single, ["_me", "_older"], prefix="b", **common)
    d = asof(d, single, ["_me", "_newer"], prefix="f", forward=True, **common)
    # a target exactly at the point is found from both sides
    ahead_same = F.col("f_me.t") == F.col("b_me.t")
    options = F.array_compact(F.array("b_me", "b_older", F.when(~F.coalesce(ahead_same, F.lit(False)), F.col("f_me")), "f_newer"))
    reachable = F.filter(options, lambda x: (x["t"] >= F.col("_low")) & (x["t"] <= F.col("_high")))
    ranked = F.array_sort(F.transform(reachable, lambda x: F.struct(F.abs(x["t"] - F.col(time)).alias("d"), x["t"].alias("t"), x["id"].alias("id"), x["n"].alias("n"))))
    best, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    d = d.withColumn("_ranked", ranked)
    crowded = F.coalesce((best["n"] > 1) & F.lit(margin > 0), F.lit(False)) | F.coalesce(second["d"] - best["d"] < margin, F.lit(False))
    outcome = F.when(best.isNull(), "none").when(crowded, "ambiguous").otherwise("assigned")
    ok = outcome == "assigned"
    return d.select(*points.columns, F.when(ok, best["t"]).alias("match_time"), F.when(ok, best["id"]).alias("match_id"), outcome.alias("outcome"))


def nearest_clean(targets: DataFrame, samples: DataFrame, *, clean: str, near_ms: int = 2_000, far_ms: int = 5_000,
                  key: str = "session_id", tie: str = "event_id") -> DataFrame:
    """The target's own sample when clean, else the closest clean one between ``near_ms`` and ``far_ms`` away.

    At equal distance the later sample wins, since a closing overlay clears with time.
    """
    usable = samples.filter(F.col(clean)).select(key, "t_ms", tie)
    d = targets.withColumns({"_later": F.col("t_ms") + near_ms, "_earlier": F.col("t_ms") - near_ms})
    d = asof(d, usable, ["t_ms"], prefix="next_", forward=True, keys=[key], left_time="_later", left_tie=tie, right_tie=tie)
    d = asof(d, usable, ["t_ms"], prefix="prev_", keys=[key], left_time="_earlier", left_tie=tie, right_tie=tie)
    ahead = F.col("next_t_ms") - F.col("t_ms")
    back = F.col("t_ms") - F.col("prev_t_ms")
    ahead, back = F.when(ahead <= far_ms, ahead), F.when(back <= far_ms, back)
    use_ahead = ahead.isNotNull() & (back.isNull() | (ahead <= back))
    own = F.col(clean)
    used = F.when(own, F.col("t_ms")).when(use_ahead, F.col("next_t_ms")).when(back.isNotNull(), F.col("prev_t_ms"))
    state = F.when(own, "gameplay").when(used.isNotNull(), "gameplay_near_overlay").otherwise("overlay_unresolved")
    return d.select(*targets.columns, used.alias("used_ms"), state.alias("screen_state"))


def unmatched_within(left: DataFrame, right: DataFrame, tolerance: int, *, equal: Sequence[str], time: str = "t_ms",
                     item: str | None = None) -> DataFrame:
    """Left rows with no right row of the same ``equal`` columns within the tolerance.

    With ``item``, the items must also agree unless one side has none.  Right rows are reduced to distinct
    (anchor, item) keys before the join, so crowded instants do not multiply rows.
    """
    shifts = F.array(*[F.lit(step) for step in range(-tolerance, tolerance + 1)])
    spread = right.withColumn("_at", F.explode(F.transform(shifts, lambda step: F.col(time) + step)))
    here = left.withColumn("_at", F.col(time))
    if item is None:
        return here.join(spread.select(*equal, "_at").distinct(), [*equal, "_at"], "left_anti").drop("_at")
    anchors = spread.groupBy(*equal, "_at").agg(F.bool_or(F.col(item).isNull()).alias("_open"))
    named = spread.filter(F.col(item).isNotNull()).select(*equal, "_at", F.col(item).alias(item)).distinct().withColumn("_named", F.lit(True))
    d = here.join(anchors, [*equal, "_at"], "left").join(named, [*equal, "_at", item], "left")
    hit = F.col("_open").isNotNull() & (F.col("_open") | F.col(item).isNull() | F.coalesce("_named", F.lit(False)))
    return d.filter(~hit).select(*left.columns)


def table_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that differ between two versions of a table and the columns they differ in."""
    values = [name for name in left.columns if name not in keys]
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    changed = F.concat_ws("|", *[F.when(~F.col(f"_a.{name}").eqNullSafe(F.col(f"_b.{name}")), F.lit(name)) for name in values])
    kind = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("changed")
    return both.withColumns({"kind": kind, "columns": F.when(kind == "changed", changed).otherwise("")}).filter(
        (F.col("kind") != "changed") | (F.col("columns") != "")).select(*keys, "kind", "columns")
