"""Gaps-and-islands over flagged samples, and merging of intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.operators.ordering import TimeOrder, island_ids, last_seen, running_max, running_sum, time_order


def runs(df: DataFrame, order: TimeOrder, member: Column, *, gap_ms: int | None = None, interrupted: Column | None = None,
         breaks_on_other: bool = False, time: str = "t_ms", name: str = "island") -> DataFrame:
    """Member rows with the number of the run they belong to.

    A run ends when the time to the previous member exceeds ``gap_ms``, when an ``interrupted`` row lies in
    between, or (``breaks_on_other``) when any non-member row lies in between.
    """
    order_df = order.tag(df)
    breaker = ~member if breaks_on_other else interrupted
    specs = {"_prev": last_seen(F.when(member, F.col(time)), exclusive=True)}
    if breaker is not None:
        specs["_breaks"] = running_sum(F.when(breaker, 1).otherwise(0).cast("long"))
    out = order.running(order_df, **specs).filter(member)
    opens = F.col("_prev").isNull()
    if gap_ms is not None:
        opens = opens | (F.col(time) - F.col("_prev") > gap_ms)
    if breaker is not None:
        out = order.frames(out, 1, _breaks_before=lambda w: F.lag("_breaks").over(w))
        opens = opens | (F.col("_breaks") != F.coalesce(F.col("_breaks_before"), F.lit(-1)))
        out = island_ids(out, order, opens, name).drop("_breaks", "_breaks_before", "_prev")
    else:
        out = island_ids(out, order, opens, name).drop("_prev")
    return order.untag(out)


def merge_overlapping(intervals: DataFrame, *, keys: Sequence[str] = ("session_id",), start: str = "start_ms",
                      end: str = "end_ms", tie: str = "event_id", slack: int = 0,
                      aggs: Sequence[Column] = ()) -> DataFrame:
    """Merge intervals that overlap, touch, or lie within ``slack`` of each other."""
    order = time_order(intervals, keys, (start, tie))
    out = order.running(order.tag(intervals), _reach=running_max(F.col(end), exclusive=True))
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + slack)
    out = island_ids(out, order, opens, "_no")
    return order.untag(out).groupBy(*keys, "_no").agg(
        F.min(start).alias(start), F.max(end).alias(end), *aggs).drop("_no")


def segment_ids(df: DataFrame, order: TimeOrder, blocked: Column, name: str = "segment_id") -> DataFrame:
    """Gameplay segment of each row: it increases whenever a blocked stretch begins."""
    d = order.frames(order.tag(df.withColumn("_blocked", blocked)), 1, _was=lambda w: F.lag("_blocked").over(w))
    begins = F.col("_blocked") & ~F.coalesce("_was", F.lit(False))
    return order.untag(island_ids(d, order, begins, name)).drop("_blocked", "_was")


def blocked_intervals(frames: DataFrame, order: TimeOrder, *, frame: str, blocked: Column, phase: str) -> DataFrame:
    """Contiguous blocked frames as half-open intervals with their phases in order of appearance."""
    d = runs(frames, order, blocked, gap_ms=1, time=frame, name="_no")
    keys = [*order.keys, "_no"]
    per_phase = d.groupBy(*keys, phase).agg(F.min(frame).alias("_first"), F.max(frame).alias("_last"), F.count(F.lit(1)).alias("_n"))
    listed = F.array_sort(F.collect_list(F.struct("_first", F.col(phase).alias("p"), F.col("_n").alias("n"))))
    return per_phase.groupBy(*keys).agg(
        F.min("_first").alias("start_frame"), (F.max("_last") + 1).alias("end_frame"), listed.alias("_l")
    ).select(*order.keys, "start_frame", "end_frame", F.transform("_l", lambda x: x["p"]).alias("phases"),
             F.transform("_l", lambda x: x["n"]).alias("phase_frames"))


def pause_type(phases: Column) -> Column:
    treasure = (F.size(phases) > 0) & F.forall(phases, lambda p: p.startswith("treasure_"))
    return (F.when(F.array_contains(phases, "level_up_menu"), "level_up_pause")
            .when(F.array_contains(phases, "treasure_menu") | treasure, "treasure_pause")
            .otherwise("unresolved_interruption_pause"))


def state_runs(df: DataFrame, order: TimeOrder, state: str) -> DataFrame:
    """Consecutive rows that share a state get the same run number."""
    d = order.frames(order.tag(df), 1, _was=lambda w: F.lag(state).over(w))
    return order.untag(island_ids(d, order, ~F.col(state).eqNullSafe(F.col("_was")), "run")).drop("_was")


def rolling_history(df: DataFrame, order: TimeOrder, observable: Column, rows: int, **values: Column) -> DataFrame:
    """Arrays of the last ``rows`` values since the last unobservable row, not counting the row itself."""
    d = order.running(order.tag(df.withColumn("_ok", observable)), _gap=running_sum(F.when(F.col("_ok"), 0).otherwise(1).cast("long")))
    packed = F.struct(F.col("_gap").alias("g"), F.col("_ok").alias("ok"), *[value.alias(name) for name, value in values.items()])
    d = order.frames(d.withColumn("_packed", packed), rows, _past=lambda w: F.collect_list("_packed").over(w.rowsBetween(-rows, -1)))
    past = F.filter("_past", lambda x: x["ok"] & (x["g"] == F.col("_gap")))
    d = d.withColumn("_past", F.when(F.col("_ok"), past))
    d = d.withColumns({f"{name}_history": F.col("_past").getField(name) for name in values})
    return order.untag(d).drop("_ok", "_gap", "_packed", "_past")


def span_status(windows: DataFrame, gaps: DataFrame, *, duration: str, start: str = "start_ms", end: str = "end_ms",
                key: str = "session_id", tie: str = "window_id", gap_tie: str = "event_id") -> DataFrame:
    """Whether a recording covers each window; touching a gap is not overlapping it."""
    from sessionlake.operators.timejoin import stream_join

    marks = gaps.select(key, F.col(start).alias("_gap_start"), F.col(end).alias("_gap_end"), gap_tie)
    d = stream_join(windows, marks, {"_reach": running_max(F.col("_right._gap_end"))}, keys=[key], left_time=end,
                    right_time="_gap_start", left_tie=tie, right_tie=gap_tie, right_first=False)
    status = (F.when(F.col(duration).isNull() | (F.col(duration) <= F.col(start)), "absent")
              .when(F.col(duration) < F.col(end), "partial").when(F.col("_reach") > F.col(start), "gap").otherwise("span-only"))
    return d.withColumn("status", status).drop("_reach")


def merge_fragments(fragments: DataFrame, order: TimeOrder, fps: float, *, treasure_gap_s: float = 0.25, orphan_frames: int = 2,
                    orphan_gap: int = 1, leading_frames: int = 6, leading_gap: int = 4) -> DataFrame:
    """Join fragments of one interaction that a classifier dropout has split.

    Whether a fragment joins depends on everything merged before it, so this is a fold over the intervals of a
    session.  Adjacent menus stay separate; only treasure parts and transition remnants bridge a gap.
    """
    treasure_gap = max(1, round(fps * treasure_gap_s))

    def transition_only(x):
        return bool(x["phases"]) and all(p.endswith("_transition") for p in x["phases"])

    def length(x):
        return x["end"] - x["start"]

    def treasure(x):
        return "treasure_menu" in x["phases"] or (bool(x["phases"]) and all(p.startswith("treasure_") for p in x["phases"]))

    def reason(a, b):
        gap = b["start"] - a["end"]
        if gap < 0:
            return None
        if gap <= treasure_gap and treasure(a) and treasure(b):
            return "treasure_components_across_brief_visual_dropout"
        if gap <= orphan_gap and any(length(x) <= orphan_frames and transition_only(x) for x in (a, b)):
            return "short_transition_fragment_across_one_frame_gap"
        if gap > leading_gap:
            return None
        if "level_up_menu" in b["phases"] and length(a) <= leading_frames:
            if transition_only(a):
                return "leading_transition_fragment_before_level_up_menu"
            menu = a["counts"].get("level_up_menu", 0)
            moving = sum(n for p, n in a["counts"].items() if p.endswith("_transition"))
            if set(a["phases"]) <= {"level_up_transition", "level_up_menu"} and moving > menu:
                return "transition_dominant_level_up_onset_before_stable_menu"
        if "level_up_menu" in a["phases"] and length(b) <= leading_frames and transition_only(b):
            return "trailing_transition_fragment_after_level_up_menu"
        return None

    def emit(x):
        return [] if x is None else [(x["start"], x["end"], x["phases"], x["parts"], x["gap"], x["reason"])]

    def step(state, row):
        start, end, phases, counts = row
        new = {"start": start, "end": end, "phases": list(phases), "counts": dict(zip(phases, counts)), "parts": 1, "gap": 0, "reason": None}
        why = reason(state, new) if state else None
        if why is None:
            return new, emit(state)
        merged = dict(state)
        merged["phases"] = state["phases"] + [p for p in new["phases"] if p not in state["phases"]]
        merged["counts"] = {p: state["counts"].get(p, 0) + new["counts"].get(p, 0) for p in merged["phases"]}
        merged.update(end=end, parts=state["parts"] + 1, gap=state["gap"] + start - state["end"], reason=why)
        return merged, []

    from sessionlake.operators.folds import session_fold

    out = session_fold(fragments, order, ["start_frame", "end_frame", "phases", "phase_frames"], step,
                       "start_frame long, end_frame long, phases array<string>, components long, merged_gap_frames long, merge_reason string",
                       finish=emit)
    return out.withColumn("event_type", pause_type(F.col("phases")))


def assign_to_events(fragments: DataFrame, events: DataFrame, *, leading_ms: int = 750, trailing_ms: int = 2_500,
                     key: str = "session_id") -> DataFrame:
    """The accepted selection each pause fragment belongs to, if any.

    A selection inside a fragment is at distance 0, one shortly after its end or (for pure transitions) shortly
    before its start is at that distance.  Only the next and the previous selection can be closest.
    ``fragments``: ``start_ms, end_ms, phases, fragment_id``; ``events``: ``t_ms, event_id``.
    """
    from sessionlake.operators.timejoin import asof

    single = events.groupBy(key, "t_ms").agg(F.min("event_id").alias("event_id"))
    common = dict(keys=[key], left_time="start_ms", left_tie="fragment_id")
    d = asof(fragments, single, ["t_ms", "event_id"], prefix="next_", forward=True, **common)
    d = asof(d, single, ["t_ms", "event_id"], prefix="prev_", strict=True, **common)
    level = (F.size("phases") > 0) & F.forall("phases", lambda p: p.isin("level_up_transition", "level_up_menu"))
    moving = level & ~F.array_contains("phases", "level_up_menu")
    ahead = F.when(F.col("next_t_ms").isNotNull(), F.greatest(F.col("next_t_ms") - F.col("end_ms"), F.lit(0)))
    behind = F.col("start_ms") - F.col("prev_t_ms")
    ahead = F.when(level & (ahead <= leading_ms), ahead)
    behind = F.when(moving & (behind <= trailing_ms), behind)
    use_prev = behind.isNotNull() & (ahead.isNull() | (behind <= ahead))
    return d.withColumns({
        "event_id": F.when(use_prev, F.col("prev_event_id")).when(ahead.isNotNull(), F.col("next_event_id")),
        "event_ms": F.when(use_prev, F.col("prev_t_ms")).when(ahead.isNotNull(), F.col("next_t_ms")),
        "event_distance_ms": F.when(use_prev, behind).otherwise(ahead),
    }).drop("next_t_ms", "next_event_id", "prev_t_ms", "prev_event_id")


def bridge_with_evidence(intervals: DataFrame, evidence: DataFrame, slack_ms: int = 500, key: str = "session_id") -> DataFrame:
    """Widen each accepted evidence interval to the visual intervals it touches within the slack.

    ``intervals`` are disjoint, so the touched ones form a stretch: the first that ends late enough and the last
    that starts early enough.  Adds ``matched`` next to the widened ``start_ms`` / ``end_ms``.
    """
    from sessionlake.operators.timejoin import asof

    low = evidence.withColumn("_from", F.col("start_ms") - slack_ms).withColumn("_to", F.col("end_ms") + slack_ms)
    seen = intervals.select(key, F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("start_ms").alias("_tie"))
    d = asof(low, seen, ["s", "e"], prefix="first_", forward=True, keys=[key], left_time="_from", right_time="e", left_tie="event_id", right_tie="_tie")
    d = asof(d, seen, ["s", "e"], prefix="last_", keys=[key], left_time="_to", right_time="s", left_tie="event_id", right_tie="_tie")
    matched = F.coalesce((F.col("first_s") <= F.col("_to")) & (F.col("last_e") >= F.col("_from")), F.lit(False))
    return d.withColumns({
        "matched": matched,
        "start_ms": F.when(matched, F.least("start_ms", "first_s")).otherwise(F.col("start_ms")),
        "end_ms": F.when(matched, F.greatest("end_ms", "last_e")).otherwise(F.col("end_ms")),
    }).drop("_from", "_to", "first_s", "first_e", "last_s", "last_e")


def distinct_menus(segments: DataFrame, order: TimeOrder, tolerance_ms: int = 500) -> DataFrame:
    """Drop repeats of the last kept menu (same bounds and choice); the one that ends later stays."""

    def emit(x):
        return [] if x is None else [tuple(x)]

    def step(kept, row):
        start, end, item, index, tie = row
        if kept and abs(start - kept[0]) < tolerance_ms and abs(end - kept[1]) < tolerance_ms and [item, index] == kept[2:4]:
            return (list(row) if end > kept[1] else kept), []
        return list(row), emit(kept)

    from sessionlake.operators.folds import session_fold

    return session_fold(segments, order, ["start_ms", "end_ms", "item", "selected_index", "event_id"], step,
                        "start_ms long, end_ms long, item string, selected_index long, event_id long", finish=emit)


def menu_segments(samples: DataFrame, order: TimeOrder, *, window: str, options: str, reliable: str, time: str = "t_ms",
                  misses: int = 2, split_ms: int = 300) -> DataFrame:
    """Menus from sampled option rows inside search windows.

    A menu opens at the first sample with options, closes after ``misses`` empty samples or with its window, splits
    when the option count changes once it has lasted ``split_ms``, and keeps its last reliable sample.
    """

    def emit(m):
        return [] if m is None or m.get("open") is None else [(m["window"], m["open"], m["seen"], m["count"], m["outcome"])]

    def step(state, row):
        place, at, count, good, tie = row
        out = []
        if state is not None and state["window"] != place:
            out, state = emit(state), None
        state = dict(state) if state else {"window": place, "open": None}
        if not count:
            if state["open"] is not None:
                state["missed"] += 1
                if state["missed"] >= misses:
                    out += emit(state)
                    state = {"window": place, "open": None}
            return state, out
        if state["open"] is not None and count != state["count"] and at - state["open"] >= split_ms:
            out += emit(state)
            state = {"window": place, "open": None}
        if state["open"] is None:
            state = {"window": place, "open": at, "outcome": None}
        state.update(seen=at, count=count, missed=0)
        if good:
            state["outcome"] = tie
        return state, out

    from sessionlake.operators.folds import session_fold

    return session_fold(samples, order, [window, time, options, reliable, order.by[-1]], step,
                        "window_id long, start_ms long, end_ms long, option_count long, outcome_event_id long", finish=emit)
