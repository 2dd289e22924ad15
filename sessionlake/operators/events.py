"""Events derived from persistent changes, and progress points across interruptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.operators.ordering import Running, TimeOrder, island_ids, running_sum, time_order
from sessionlake.operators.timejoin import asof, inside_any, stream_join

FAR_FRAMES = 1_000_000


def neighbours(df: DataFrame, order: TimeOrder, **fields: str) -> DataFrame:
    """Previous and next value of each field as ``prev_<name>`` and ``next_<name>``."""
    makers = {}
    for name, column in fields.items():
        makers[f"prev_{name}"] = lambda w, c=column: F.lag(c).over(w)
        makers[f"next_{name}"] = lambda w, c=column: F.lead(c).over(w)
    return order.untag(order.frames(order.tag(df), 1, **makers))


def persistent_changes(samples: DataFrame, order: TimeOrder, value: str, observed: str, segment: str, *,
                       minimum: float = 3.0, max_gap_ms: int = 1_500, tolerance: float = 1.5) -> DataFrame:
    """Changes of a level that the next direct reading confirms; gaps and segment borders are never bridged."""
    d = neighbours(samples, order, v=value, o=observed, s=segment, t="t_ms")
    v = F.col(value)
    delta = v - F.col("prev_v")
    direct = F.col(observed) & F.col("prev_o") & F.col("next_o")
    together = (F.col("prev_s") == F.col(segment)) & (F.col("next_s") == F.col(segment))
    close = (F.col("t_ms") - F.col("prev_t") <= max_gap_ms) & (F.col("next_t") - F.col("t_ms") <= max_gap_ms)
    lasts = F.when(delta < 0, F.col("next_v") <= v + tolerance).otherwise(F.col("next_v") >= v - tolerance)
    return d.filter(direct & together & close & (F.abs(delta) >= minimum) & lasts).select(
        *order.keys, *order.by, F.when(delta < 0, "hp_loss").otherwise("hp_recovery").alias("event_type"),
        F.when(delta < 0, "punishment").otherwise("recovery").alias("event_family"),
        F.col("prev_t").alias("time_lower_ms"), F.abs(delta).alias("quantity"), F.col("prev_v").alias("previous_value"),
        v.alias("current_value"), F.col("next_v").alias("following_value"))


def isolated_short(samples: DataFrame, order: TimeOrder, width: str, excluded: str, threshold: float = 40.0) -> DataFrame:
    """Blank short readings that have no short neighbour; excluded rows keep their own state."""
    d = neighbours(samples, order, w=width)
    short = lambda name: F.coalesce(F.col(name) < threshold, F.lit(False))
    lone = ~F.col(excluded) & short(width) & ~short("prev_w") & ~short("next_w")
    return d.select(*samples.columns, F.when(~lone, F.col(width)).alias("accepted_width"),
                    F.when(lone, "isolated_short_component").alias("rejection_reason"))


def full_scale(samples: DataFrame, keys: list[str], width: str, *, radius: int = 1, minimum_rows: int = 10) -> DataFrame:
    """Highest repeatedly observed width cluster per session and the upper median of its readings."""
    usable = samples.filter(F.col(width) > 0)
    counted = usable.groupBy(*keys, F.col(width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    cells = counted.groupBy(*keys, F.bround("w").cast("long").alias("cell")).agg(F.sum("n").alias("n"))
    near = Window.partitionBy(*keys).orderBy("cell").rangeBetween(-radius, radius)
    session = Window.partitionBy(*keys)
    cells = cells.withColumns({"support": F.sum("n").over(near), "total": F.sum("n").over(session)})
    cells = cells.withColumn("peak", F.max("support").over(session))
    fit = (F.col("support") >= F.greatest(F.lit(5), F.ceil(0.02 * F.col("total")))) & (F.col("support") >= 0.5 * F.col("peak"))
    centres = cells.filter((F.col("total") >= minimum_rows) & fit).groupBy(*keys).agg(
        F.max("cell").alias("center"), F.max("total").alias("observation_count"))
    members = counted.join(centres, keys).filter(F.abs(F.col("w") - F.col("center")) <= radius)
    upto = Window.partitionBy(*keys).orderBy("w")
    members = members.withColumns({"upto": F.sum("n").over(upto), "size": F.sum("n").over(session)})
    middle = F.floor(F.col("size") / 2)
    hit = (F.col("upto") > middle) & (F.col("upto") - F.col("n") <= middle)
    return members.groupBy(*keys, "center", "observation_count").agg(
        F.max(F.when(hit, F.col("w"))).alias("full_width"), F.max("size").alias("cluster_support"))


def confirmed_gains(samples: DataFrame, order: TimeOrder, value: str, usable: str, segment: str, confidence: str, *,
                    max_gap_ms: int = 2_000, minimum_confidence: float = 0.8) -> DataFrame:
    """Counter increases whose new value repeats; unusable rows stay in the sequence and break it."""
    d = neighbours(samples, order, v=value, u=usable, s=segment, t="t_ms", c=confidence)
    together = (F.col("prev_s") == F.col(segment)) & (F.col("next_s") == F.col(segment))
    back, ahead = F.col("t_ms") - F.col("prev_t"), F.col("next_t") - F.col("t_ms")
    near = (back > 0) & (back <= max_gap_ms) & (ahead > 0) & (ahead <= max_gap_ms)
    sure = F.least("prev_c", confidence) >= minimum_confidence
    delta = F.col(value) - F.col("prev_v")
    keep = F.col(usable) & F.col("prev_u") & F.col("next_u") & together & near & sure & (F.col("next_v") == F.col(value)) & (delta > 0)
    return d.filter(keep).select(*order.keys, *order.by, F.col("prev_t").alias("time_lower_ms"), delta.alias("quantity"),
                                 F.col("next_t").alias("confirmed_at_ms"))


def isolation(events: DataFrame, order: TimeOrder, time: str, within: int) -> DataFrame:
    """Gaps to the previous and next event and whether both exceed ``within``."""
    d = neighbours(events, order, t=time)
    back = F.coalesce(F.col(time) - F.col("prev_t"), F.lit(FAR_FRAMES))
    ahead = F.coalesce(F.col("next_t") - F.col(time), F.lit(FAR_FRAMES))
    return d.select(*events.columns, back.alias("previous_gap"), ahead.alias("next_gap"), ((back > within) & (ahead > within)).alias("isolated"))


def break_flags(points: DataFrame, order: TimeOrder, level: str, progress: str, *, gap_ms: int = 2_000, drop: float = 25) -> DataFrame:
    """``break_before``: first point, new level, long gap or a large fall."""
    d = order.untag(order.frames(order.tag(points), 1, _l=lambda w: F.lag(level).over(w), _t=lambda w: F.lag("t_ms").over(w),
                                 _p=lambda w: F.lag(progress).over(w)))
    breaks = F.col("_l").isNull() | (F.col(level) != F.col("_l")) | (F.col("t_ms") - F.col("_t") > gap_ms) | (F.col(progress) < F.col("_p") - drop)
    return d.withColumn("break_before", breaks).drop("_l", "_t", "_p")


def distinct_points(points: DataFrame, order: TimeOrder, identity: list[str], anchor: str) -> DataFrame:
    """One row per run of identical consecutive points: the last anchor if there is one, else the first point."""
    d = order.frames(order.tag(points.withColumn("_id", F.struct(*identity))), 1, _was=lambda w: F.lag("_id").over(w))
    d = order.untag(island_ids(d, order, ~F.col("_id").eqNullSafe(F.col("_was")), "_run"))
    position = F.struct(*order.by)
    row = F.struct(*points.columns)
    chosen = F.coalesce(F.max_by(row, F.when(F.col(anchor).isNotNull(), position)), F.min_by(row, position))
    return d.groupBy(*order.keys, "_run").agg(chosen.alias("_row")).select("_row.*")


def interruption_holds(points: DataFrame, changes: DataFrame, intervals: DataFrame, *, level: str, progress: str,
                       key: str = "session_id") -> DataFrame:
    """Flat stretches of progress across merged interruptions, cut at level changes inside them.

    ``intervals`` are disjoint (``start_ms, end_ms``); the state held is the last point at or before each cut.
    """
    boxes = intervals.select(key, "start_ms", "end_ms", F.col("start_ms").alias("_tie"))
    inner = changes.groupBy(key, "t_ms").agg(F.min("event_id").alias("event_id"))
    inner = asof(inner, boxes, ["start_ms", "end_ms"], keys=[key], strict=True, right_time="start_ms", right_tie="_tie").filter(
        F.col("t_ms") < F.col("end_ms"))
    cuts = boxes.select(key, F.col("start_ms").alias("cut_ms"), "start_ms", "end_ms").unionByName(
        inner.select(key, F.col("t_ms").alias("cut_ms"), "start_ms", "end_ms"))
    order = time_order(cuts, key, ("cut_ms", "start_ms"))
    d = order.untag(order.frames(order.tag(cuts), 1, _next=lambda w: F.lead("cut_ms").over(w), _owner=lambda w: F.lead("start_ms").over(w)))
    stop = F.when(F.col("_owner") == F.col("start_ms"), F.col("_next")).otherwise(F.col("end_ms"))
    d = d.select(key, F.col("start_ms").alias("interval_ms"), "cut_ms", stop.alias("stop_ms"))
    held = asof(d, points, [level, progress], keys=[key], left_time="cut_ms", left_tie="interval_ms")
    return held.filter(F.col(level).isNotNull()).select(key, F.col("cut_ms").alias("start_ms"), F.col("stop_ms").alias("end_ms"), level, progress)


def points_outside(points: DataFrame, intervals: DataFrame, anchor: Column, key: str = "session_id") -> DataFrame:
    """Points that are anchors or do not lie strictly inside an interruption."""
    d = inside_any(points, intervals, keys=[key], open_start=True, name="_inside")
    return d.filter(anchor | ~F.col("_inside")).drop("_inside")


def segments_outside(segments: DataFrame, intervals: DataFrame, *, tie: str, key: str = "session_id") -> DataFrame:
    """Segments ``start_ms..end_ms`` that overlap no interruption (touching is allowed)."""
    boxes = intervals.select(key, F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.lit(0).alias("_no"))
    d = stream_join(segments, boxes, {"_reach": Running("max", F.col("_right._e"))}, keys=[key], left_time="end_ms",
                    right_time="_s", left_tie=tie, right_tie="_no", right_first=False)
    return d.filter(F.col("_reach").isNull() | (F.col("_reach") <= F.col("start_ms"))).drop("_reach")


def levels_from_selections(points: DataFrame, completions: DataFrame, changes: DataFrame, *, level: str, key: str = "session_id") -> DataFrame:
    """Replace levels by the number of completed selections where these outnumber the observed level changes."""
    done = completions.groupBy(key).agg(F.count(F.lit(1)).alias("_done"))
    seen = changes.groupBy(key).agg(F.count(F.lit(1)).alias("_seen"), F.min_by("from_level", F.struct("t_ms", "event_id")).alias("_from"))
    lowest = points.groupBy(key).agg(F.min(level).alias("_low"))
    facts = lowest.join(done, key, "left").join(seen, key, "left")
    facts = facts.select(key, (F.coalesce("_done", F.lit(0)) > F.coalesce("_seen", F.lit(0))).alias("reconciled"),
                         F.coalesce("_from", "_low", F.lit(1)).alias("_initial"))
    count = running_sum(F.when(F.col("_right").isNotNull(), 1).otherwise(0).cast("long"))
    d = stream_join(points, completions.select(key, "t_ms", "event_id"), {"_n": count}, keys=[key])
    return d.join(facts, key).withColumn(level, F.when(F.col("reconciled"), F.col("_initial") + F.col("_n")).otherwise(F.col(level))).drop("_n", "_initial")


def accepted_levels(candidates: DataFrame, order: TimeOrder, initial_level: int) -> DataFrame:
    """Level changes that continue the sequence, and the reason for each one that does not.

    ``candidates``: ``from_level`` (NULL for a first visible level), ``to_level``.  A jump ahead is accepted only when
    no later candidate could still supply a missing level, which needs the last place every level appears.
    """
    key = order.keys[0]
    valid = F.col("from_level").isNotNull() & (F.col("to_level") == F.col("from_level") + 1)
    d = order.untag(order.running(order.tag(candidates), _no=running_sum(F.lit(1).cast("long"))))
    last = d.filter(valid).groupBy(key, "from_level").agg(F.max("_no").alias("_last"))
    table = last.groupBy(key).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("from_level").cast("string"), "_last")))).alias("_levels"))
    d = d.join(table, key, "left")
    tie = order.by[-1]

    def step(expected, row):
        import json

        number, source, target, levels, ident = row
        expected = initial_level if expected is None else expected
        if target <= expected:
            return expected, []
        follows = target == expected + 1
        exact = source == expected and follows
        visible = source is None and follows
        leap = False
        if source is not None and source > expected and target == source + 1:
            places = json.loads(levels or "{}")
            leap = not any(places.get(str(level), 0) > number for level in range(expected, source))
        if exact or visible or leap:
            kind = "exact" if exact else "first_visible" if visible else "after_gap"
            return target, [(ident, expected if visible else source, target, kind, None)]
        reason = ("first_visible_hud_level_skips_intermediate_levels" if source is None
                  else "non_consecutive_hud_or_xp_transition" if target != source + 1
                  else "transition_conflicts_with_monotonic_game_level")
        return expected, [(ident, source, target, "unresolved", reason)]

    from sessionlake.operators.folds import session_fold

    return session_fold(d, order, ["_no", "from_level", "to_level", "_levels", tie], step,
                        f"{tie} long, from_level long, to_level long, acceptance string, reason string")


def bar_increases(frames: DataFrame, order: TimeOrder, *, bar_width: int, min_quality: float = 0.78, hud_floor: float = 0.90,
                  overlay_max: float = 0.05, strong_overlay: float = 0.30, tolerance: int = 1, lookahead: int = 3) -> DataFrame:
    """Measured pickups: a step up of the bar that passes the quality gates at both ends and does not fall back.

    ``frames``: ``pixels, quality, hud, overlay, health_bar, guarded, reappeared``.
    """
    good = (F.col("hud") >= hud_floor) & (F.col("quality") >= min_quality) & (F.col("overlay") < overlay_max) & ~F.col("reappeared")
    d = frames.withColumn("_later", F.when(good, F.col("pixels")))
    names = ("pixels", "quality", "hud", "overlay", "health_bar", "guarded", "reappeared")
    makers = {f"a_{name}": (lambda w, n=name: F.lag(n).over(w)) for name in names}
    makers["_next"] = lambda w: F.first("_later", ignorenulls=True).over(w.rowsBetween(1, lookahead))
    d = order.untag(order.frames(order.tag(d), lookahead, **makers))
    delta = F.col("pixels") - F.col("a_pixels")
    full = F.col("pixels") >= bar_width - 2
    bars = F.col("health_bar") & F.col("a_health_bar")
    clear = lambda p: (F.col(f"{p}hud") >= hud_floor) & (F.col(f"{p}quality") >= min_quality) & ((F.col(f"{p}overlay") < overlay_max) | (full & bars))
    ordinary = clear("a_") & clear("")
    low_fill = ((F.col("a_pixels") < 0.03 * bar_width) & bars & (F.col("a_hud") >= hud_floor) & (F.col("hud") >= hud_floor)
                & (F.col("quality") >= min_quality) & (F.col("a_overlay") < strong_overlay) & (F.col("overlay") < strong_overlay))
    hidden_then_full = (F.col("a_pixels") <= tolerance) & full
    touched = F.col("guarded") | F.col("a_guarded") | F.col("reappeared") | F.col("a_reappeared")
    falls = F.coalesce(F.col("_next") < F.col("pixels") - tolerance, F.lit(False))
    keep = (delta >= 1) & ~hidden_then_full & ~touched & (ordinary | low_fill) & ~falls
    return d.filter(keep).select(*order.keys, *order.by, delta.alias("delta_pixels"), full.alias("saturated"),
                                 F.when(ordinary, "ordinary_persistent_xp_increase").otherwise("low_fill_xp_increase").alias("detection_reason"))


