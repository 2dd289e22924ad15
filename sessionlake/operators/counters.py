"""Validation and repair of noisy cumulative counters.

Repairs keep the raw reading and state a reason; a reading that cannot be trusted is dropped or left NULL, never
filled in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.scalars import mean_median
from sessionlake.operators.folds import session_fold
from sessionlake.operators.ordering import Running, TimeOrder, last_seen, running_max, running_min, running_sum, time_order

SHIFT_REASON = "persistent_leading_place_ocr_shift_corrected"
SPIKE_REASON = "isolated_cumulative_counter_ocr_discontinuity_rejected"
RESTORED_REASON = "full_raw_ocr_restored"


def corroborated(points: DataFrame, order: TimeOrder, value: str, max_gap_ms: int = 2_000, time: str = "t_ms") -> DataFrame:
    """Readings whose neighbour shows the same value within the gap."""
    d = order.frames(order.tag(points), 1, _pv=lambda w: F.lag(value).over(w), _pt=lambda w: F.lag(time).over(w),
                     _nv=lambda w: F.lead(value).over(w), _nt=lambda w: F.lead(time).over(w))
    agrees = lambda v, gap: F.coalesce((F.col(v) == F.col(value)) & (gap <= max_gap_ms), F.lit(False))
    keep = agrees("_pv", F.col(time) - F.col("_pt")) | agrees("_nv", F.col("_nt") - F.col(time))
    return order.untag(d.filter(keep)).select(*points.columns)


def restored_from_text(stored: Column, text: Column, minimum_missing: int = 1_000) -> Column:
    """Struct ``(value, reason)``: the full number in the raw text when the stored one is only its tail."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    full = digits.try_cast("long")
    tail = F.coalesce((full - stored >= minimum_missing) & full.cast("string").endswith(stored.cast("string")), F.lit(False))
    return F.struct(F.when(tail, full).otherwise(stored).alias("value"),
                    F.when(tail, RESTORED_REASON).alias("reason"))


def leading_shift_repair(points: DataFrame, order: TimeOrder, value: str, *, minimum_jump: int = 1_000,
                         confirmations: int = 3) -> DataFrame:
    """Undo the first lasting shift of a leading digit; adds ``repaired`` and ``repair_reason``.

    The first reading that jumps by at least ``minimum_jump`` and whose next readings stay non-decreasing after
    one power-of-ten step is taken off opens the repair.  It ends at the first decrease.
    """
    v = F.col(value)
    d = order.frames(order.tag(points), confirmations, _prev=lambda w: F.lag(value).over(w),
                     _ahead=lambda w: F.collect_list(value).over(w.rowsBetween(0, confirmations - 1)))
    one = F.lit(1).cast("long")
    d = order.running(d, _rows=running_sum(one), _left=Running("sum", one, exclusive=True, reverse=True))
    jump = v - F.col("_prev")
    magnitude = F.pow(F.lit(10), F.greatest(F.lit(1), F.length(jump.cast("string")) - 1)).cast("long")
    rising = F.forall(F.sequence(F.lit(1), F.size("_ahead") - 1), lambda i: F.get("_ahead", i) >= F.get("_ahead", i - 1))
    rising = F.when(F.size("_ahead") < 2, True).otherwise(rising)
    fits = lambda offset: (F.forall("_ahead", lambda x: x - offset >= 0) & (v - offset >= F.col("_prev"))
                           & (v - offset - F.col("_prev") < minimum_jump))
    offsets = F.filter(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda m: magnitude * m), fits)
    ranked = F.transform(offsets, lambda o: F.struct(F.abs(v - o - F.col("_prev")).alias("miss"), o.alias("offset")))
    long_enough = F.col("_rows") + F.coalesce(F.col("_left"), F.lit(0)) >= confirmations + 1
    opens = F.when(long_enough & (jump >= minimum_jump) & rising & (F.size(offsets) > 0), F.array_min(ranked)["offset"])
    d = d.withColumn("_opens", opens)
    position = F.struct(*order.by)
    first = F.when(F.col("_opens").isNotNull(), F.struct(position.alias("at"), F.col("_opens").alias("offset")))
    d = order.running(d, _shift=running_min(first))
    shifted = v - F.col("_shift.offset")
    ends = F.col("_shift").isNotNull() & ((shifted < 0) | ((position > F.col("_shift.at")) & (v < F.col("_prev"))))
    d = order.running(d.withColumn("_ends", ends.cast("int")), _ended=running_max(F.col("_ends")))
    active = F.col("_shift").isNotNull() & (F.coalesce("_ended", F.lit(0)) == 0)
    d = d.withColumns({"repaired": F.when(active, shifted).otherwise(v), "repair_reason": F.when(active, SHIFT_REASON)})
    return order.untag(d).select(*points.columns, "repaired", "repair_reason")


def isolated_repair(points: DataFrame, order: TimeOrder, value: str) -> DataFrame:
    """Hold the previous value over a single impossible spike or drop that the next reading takes back."""
    d = order.untag(order.frames(order.tag(points), 1, _next=lambda w: F.lead(value).over(w)))

    def step(previous, row):
        *ids, current, following = row
        if previous is not None and following is not None and following >= previous:
            spike = current > previous and following < current
            if spike or current < previous:
                return previous, [(*ids, current, previous, SPIKE_REASON)]
        return current, [(*ids, current, current, None)]

    ids = list(order.by)
    ddl = ", ".join(f"{name} long" for name in ids)
    return session_fold(d, order, [*ids, value, "_next"], step, f"{ddl}, {value} long, repaired long, repair_reason string")


def repaired_counter(points: DataFrame, order: TimeOrder, value: str) -> DataFrame:
    """Leading-digit repair first, then isolated repair; the later reason stands."""
    shifted = leading_shift_repair(points.select(*order.keys, *order.by, value), order, value)
    final = isolated_repair(shifted.select(*order.keys, *order.by, F.col("repaired").alias("_v")), order, "_v")
    ids = [*order.keys, *order.by]
    late = final.select(*ids, F.col("repaired").alias("_final"), F.col("repair_reason").alias("_late"))
    return shifted.join(late, ids).select(*ids, value, F.col("_final").alias("repaired"),
                                          F.coalesce("_late", "repair_reason").alias("repair_reason"))


def counter_summary(points: DataFrame, order: TimeOrder, value: str) -> DataFrame:
    """Per session: size, monotonicity, largest increase and how many readings repeat an earlier value."""
    d = order.untag(order.frames(order.tag(points), 1, _delta=lambda w: F.col(value) - F.lag(value).over(w)))
    facts = d.groupBy(*order.keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_delta") < 0).alias("negative_deltas"),
        F.coalesce(F.max("_delta"), F.lit(0)).cast("long").alias("largest_increase"))
    distinct = points.groupBy(*order.keys, value).agg(F.count(F.lit(1)).alias("_n")).groupBy(*order.keys).agg(
        F.sum(F.col("_n") - 1).cast("long").alias("repeated_values"))
    return facts.join(distinct, list(order.keys)).withColumn("monotonic", F.col("negative_deltas") == 0)


def action_counts(text: Column, actions: tuple[str, ...]) -> dict[str, Column]:
    """Remaining uses of each menu action; a leading plus sign misread as 4 is taken off."""
    out = {}
    for name in actions:
        digits = F.regexp_extract(text, rf"(?i){name}\s*\+?\s*(\d+)", 1)
        plain = F.when(digits != "", digits.cast("long"))
        without = F.substring(digits, 2, 64).try_cast("long")
        misread = (F.length(digits) >= 4) & digits.startswith("4") & (without <= 999)
        out[name] = F.when(misread, without).otherwise(plain)
    return out


def confirmed_drops(rows: DataFrame, order: TimeOrder, value: str, time: str = "t_ms", *, lookahead: int = 3,
                    terminal_drop: int = 3) -> DataFrame:
    """One event per unit of every confirmed decrease of a counter that can only fall.

    A lower reading counts when one of the next readings shows it again, or when it is the last reading and the
    drop is small.  The stable value is therefore the running minimum of the first reading and of confirmed ones.
    """
    d = order.tag(rows.filter(F.col(value).isNotNull()))
    v = F.col(value)
    d = order.frames(d, lookahead, _ahead=lambda w: F.collect_list(value).over(w.rowsBetween(1, lookahead)))
    d = order.running(d, _no=running_sum(F.lit(1).cast("long")), _raw_min=running_min(v, exclusive=True))
    again = F.array_contains("_ahead", v)
    first = F.col("_no") == 1
    # a lower last reading is judged against the stable value, which only earlier confirmed readings shape
    d = order.running(d.withColumn("_sure", F.when(first | again, v)), _stable=running_min(F.col("_sure"), exclusive=True))
    drop = F.col("_stable") - v
    takes = ~first & (drop > 0) & (again | ((F.size("_ahead") == 0) & (drop <= terminal_drop)))
    d = d.withColumns({"_takes": F.coalesce(takes, F.lit(False)), "_drop": drop})
    # the evidence interval opens at the last reading that still showed the stable value
    same = first | F.col("_takes") | (v == F.col("_stable"))
    d = order.running(d.withColumn("_same", F.when(same, F.col(time))), lower_ms=last_seen(F.col("_same"), exclusive=True))
    events = order.untag(d.filter("_takes"))
    return events.select(*order.keys, *order.by, "lower_ms", F.col("_stable").alias("counter_before"), v.alias("counter_after"),
                         again.alias("confirmed"), F.explode(F.sequence(F.lit(0), (F.col("_drop") - 1).cast("int"))).alias("unit"))


def reappearances(frames: DataFrame, order: TimeOrder, pixels: str, *, tolerance: int = 1, lookback: int = 12) -> DataFrame:
    """Flag a bar that comes back after a short unreadable gap at no less than its earlier length."""
    p = F.col(pixels)
    visible = F.when(p > tolerance, p)
    d = order.frames(order.tag(frames), lookback, _prev=lambda w: F.lag(pixels).over(w),
                     _seen=lambda w: F.last(visible, ignorenulls=True).over(w.rowsBetween(-lookback, -2)))
    hit = (p > tolerance) & (F.col("_prev") <= tolerance) & (F.col("_seen") >= p - tolerance)
    return order.untag(d.withColumn("reappeared", F.coalesce(hit, F.lit(False))).drop("_prev", "_seen"))


def transition_guard(frames: DataFrame, order: TimeOrder, strong: Column, *, minimum: int = 3, before: int = 8,
                     after: int = 8) -> DataFrame:
    """Mark runs of at least ``minimum`` strong rows together with the rows around them."""
    d = order.tag(frames.withColumn("_strong", strong))
    reach = max(before, after)
    # a row belongs to a long enough run when it lies in some window of ``minimum`` strong rows
    d = order.frames(d, reach + minimum, _full=lambda w: F.min(F.col("_strong").cast("int")).over(w.rowsBetween(-(minimum - 1), 0)),
                     _size=lambda w: F.count(F.lit(1)).over(w.rowsBetween(-(minimum - 1), 0)))
    d = d.withColumn("_closes", ((F.col("_full") == 1) & (F.col("_size") == minimum)).cast("int"))
    d = order.frames(d, reach + minimum, _near=lambda w: F.max("_closes").over(w.rowsBetween(-after, before + minimum - 1)))
    return order.untag(d.withColumn("guarded", F.col("_near") == 1)).select(*frames.columns, "guarded")


def bar_resets(frames: DataFrame, order: TimeOrder, *, hud_floor: float = 0.90, min_quality: float = 0.78, overlay_limit: float = 0.05,
               drop: float = 0.20, full: float = 0.90, low: float = 0.80, collapse_frames: int = 15) -> DataFrame:
    """Falls of a nearly full bar to a low one, as `frame` (from 1) and row at which each begins, beside the row of the fall.

    ``frames`` hold ``pixels, quality, hud, overlay, guarded, reappeared, paused``. The bar is as wide as its longest reading of the session. A fall
    counts where the panel is readable on both sides, and only if, since the last reset began, more than ``collapse_frames`` frames have gone by and the
    bar has grown between two clean, unguarded frames. A fall at the end of a pause belongs to what opened the pause, however many stretches of it follow
    each other: its reset begins at the first paused frame of the run. Pauses are guarded. Null flags are false; frames with null pixels or scores are no evidence.
    """
    time, tie = order.by
    back = {name: (lambda w, name=name: F.lag(name).over(w)) for name in ("pixels", "hud", "quality", "overlay", "guarded", "paused")}
    holds = lambda name: F.coalesce(F.col(name), F.lit(False))
    flags = {"guarded": holds("guarded") | holds("paused"), "reappeared": holds("reappeared"), "paused": holds("paused")}
    d = order.tag(frames.withColumns(flags))
    d = order.frames(d, 15, **{f"_a_{name}": lag for name, lag in back.items()}, _before=lambda w: F.max("pixels").over(w.rowsBetween(-15, -1)),
                     _after=lambda w: F.collect_list("pixels").over(w.rowsBetween(0, 4)))
    d = order.running(d, frame=running_sum(F.lit(1).cast("long")), _left=running_max(F.col("pixels")), _right=Running("max", F.col("pixels"), reverse=True))
    c = F.col
    width = F.greatest(F.lit(1), "_left", "_right")
    step = c("pixels") - c("_a_pixels")
    readable = (c("hud") >= hud_floor) & (c("_a_hud") >= hud_floor)
    clean = [(c(f"{side}quality") >= min_quality) & (c(f"{side}overlay") < overlay_limit) & ~c(f"{side}guarded") for side in ("", "_a_")]
    grows = readable & (step >= 1) & clean[0] & clean[1] & ~c("reappeared")
    falls = readable & (step <= -drop * width) & (c("_before") >= full * width) & (mean_median(c("_after")) <= low * width)
    here = F.struct("frame", time, tie)
    opens = c("paused") & ~F.coalesce("_a_paused", F.lit(False))
    d = order.running(d, _opened=last_seen(F.when(opens, here), exclusive=True), _grown=last_seen(F.when(grows, c("frame")), exclusive=True))
    begin = F.when(c("_a_paused"), c("_opened")).otherwise(here)
    d = order.untag(d.filter(falls)).select(*order.keys, *order.by, c("frame").alias("_fell"), "_grown", *[begin[name].alias(f"_begin_{name}") for name in ("frame", time, tie)])

    def step_on(last, row):
        at, grown, frame, begins, ident, fell = row
        if last is not None and (at - last <= collapse_frames or grown is None or grown <= last):
            return last, []
        return frame, [(frame, begins, ident, fell)]

    return session_fold(d, order, ["_fell", "_grown", "_begin_frame", f"_begin_{time}", f"_begin_{tie}", tie], step_on, f"frame long, {time} long, {tie} long, fall_{tie} long")


def _settle_second(state):
    """The value of the second that has ended: the upper median of its valid candidates, else the last value."""
    total = sum(n for _, n, _ in state["valid"])
    for v, n, c in sorted(state["valid"]):
        if total // 2 < n:
            return v, (state["at"], v, c, "observed")
        total -= 2 * n
    return state["previous"], (state["at"], state["previous"], 0.0, "carried_forward")


def plausible_step(state, row):
    """One candidate ``(second, value, times seen, confidence)`` in order of seconds; a second without any has one with none seen."""
    at, v, n, c = row
    state, out = state or {"at": None, "previous": 0, "valid": []}, []
    previous = state["previous"]
    if state["at"] != at:
        if state["at"] is not None:
            previous, made = _settle_second(state)
            out = [made]
        state = {"at": at, "previous": previous, "valid": []}
    if n and v >= previous and (previous <= 10 or v - previous <= max(75, int(previous * 0.15))):
        state = {**state, "valid": [*state["valid"], [v, n, c]]}
    return state, out


def plausible_finish(state):
    return [_settle_second(state)[1]] if state and state["at"] is not None else []


def plausible_counter(points: DataFrame, key: str, second: str, value: str, confidence: str, tie: str) -> DataFrame:
    """Per-second validation: candidates must neither fall nor jump; the upper median is taken, else the last value.

    Candidates are first reduced to one row per distinct value, so a second costs no more than the values it shows.
    """
    seen = points.filter(F.col(value).isNotNull()).groupBy(key, second, value).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(confidence, tie).alias("_c"))
    blank = points.groupBy(key, second).agg(F.count(value).alias("_k")).filter("_k = 0").select(
        key, second, F.lit(-1).cast("long").alias(value), F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_c"))
    rows = seen.unionByName(blank)
    order = time_order(rows, key, (second, value))

    return session_fold(rows, order, [second, value, "_n", "_c"], plausible_step,
                        f"{second} long, kill_value long, confidence double, source string", finish=plausible_finish)


def required_experience(level: Column) -> Column:
    """Experience needed to finish a level."""
    base = (F.when(level <= 20, 5.0 + 10.0 * (level - 1)).when(level <= 40, 195.0 + 13.0 * (level - 20))
            .otherwise(455.0 + 16.0 * (level - 40)))
    return base + F.when(level == 20, 600.0).when(level == 40, 2400.0).otherwise(0.0)


def growth_multiplier(level: Column, base: float = 1.15) -> Column:
    return F.lit(base) + 0.10 * F.least(F.floor(level / 5), F.lit(3)) + F.when(level.isin(20, 40), 1.0).otherwise(0.0)


def value_band(gain: Column, saturated: Column, blue_max: float, green_max: float, unknown: str = "unknown") -> Column:
    usable = gain.isNotNull() & ~F.isnan(gain) & (gain > 0) & ~saturated
    return (F.when(~usable, unknown).when(gain <= blue_max, "blue").when(gain <= green_max, "green").otherwise("red"))


