"""Row contracts, quality rules and projections between table layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.operators.ordering import TimeOrder

COLOURS = ("blue", "green", "red", "unresolved")
CLOSEST_COLOUR_MINIMUM = 0.25


def listed(**rules: Column) -> Column:
    """Names of the rules that hold, joined by ``|``."""
    return F.concat_ws("|", *[F.when(rule, name) for name, rule in rules.items()])


def event_violations(events: DataFrame) -> DataFrame:
    """Events that break the contract and the rules they break."""
    c = F.col
    rules = listed(
        bounds_out_of_order=c("time_upper_ms") < c("time_lower_ms"),
        anchor_outside_bounds=(c("anchor_time_ms") < c("time_lower_ms")) | (c("anchor_time_ms") > c("time_upper_ms")),
        negative_quantity=(c("quantity") < 0) | (c("quantity_min") < 0) | (c("quantity_max") < 0),
        quantity_bounds_out_of_order=c("quantity_max") < c("quantity_min"))
    return events.withColumn("violations", rules).filter(c("violations") != "")


def ledger_violations(rows: DataFrame, order: TimeOrder, *, second: str, counter: str) -> DataFrame:
    """Seconds that are not contiguous, and counters that are negative or fall."""
    from sessionlake.operators.ordering import last_seen

    d = order.frames(order.tag(rows), 1, _s=lambda w: F.lag(second).over(w))
    d = order.untag(order.running(d, _c=last_seen(F.col(counter), exclusive=True)))
    rules = listed(second_not_contiguous=F.col(second) != F.col("_s") + 1, negative_counter=F.col(counter) < 0,
                   counter_decreases=F.col(counter) < F.col("_c"))
    return d.withColumn("violations", rules).filter(F.col("violations") != "").select(*rows.columns, "violations")


def pickup_violations(rows: DataFrame, order: TimeOrder, *, fps: float, duration_ms: int) -> DataFrame:
    """Pickup rows out of order, outside the recording, off by more than 2 ms, unbalanced or without a valid confidence."""
    d = order.untag(order.frames(order.tag(rows), 1, _f=lambda w: F.lag("frame").over(w)))
    expected = F.bround(F.col("frame") / F.lit(fps) * 1000)
    total = sum((F.col(colour) for colour in COLOURS[1:]), F.col(COLOURS[0]))
    negative = F.least(*[F.col(colour) for colour in COLOURS]) < 0
    rules = listed(frame_out_of_order=F.col("frame") < F.col("_f"), outside_duration=F.col("t_ms") > duration_ms,
                   frame_time_mismatch=F.abs(expected - F.col("t_ms")) > 2, unbalanced_categories=total != F.col("total"),
                   negative_quantity=negative, invalid_confidence=F.col("confidence").isNull() | ~F.col("confidence").between(0, 1))
    return d.withColumn("violations", rules).filter(F.col("violations") != "").select(*rows.columns, "violations")


def catalogue_violations(catalogue: DataFrame, temporal_types: Sequence[str], maturities: Sequence[str]) -> DataFrame:
    repeats = catalogue.groupBy("code").agg(F.count(F.lit(1)).alias("_n"))
    rules = listed(empty_code=F.trim("code") == "", duplicate_code=F.col("_n") > 1, unknown_temporal_type=~F.col("temporal_type").isin(*temporal_types),
                   unknown_maturity=~F.col("maturity").isin(*maturities))
    return catalogue.join(repeats, "code").withColumn("violations", rules).filter(F.col("violations") != "").select("code", "violations").distinct()


def signal_quality(code: Column, excluded: Column, value_observed: Column, ocr_observed: Column, needs_review: Column, modalities: Column) -> Column:
    """Struct ``(observed, visibility, grade)``; exclusion from gameplay wins over everything else."""
    visual = F.array_contains(modalities, "visual")
    counter, clock = code == "kill_counter", code == "game_clock"
    counted, read = F.coalesce(value_observed, F.lit(False)), F.coalesce(ocr_observed, F.lit(True))
    observed = F.when(excluded, False).when(counter, counted).when(clock, read).otherwise(True)
    visibility = (F.when(excluded, "unknown").when(counter, F.when(counted, "visible").otherwise("unknown"))
                  .when(clock, F.when(read, "visible").otherwise("partial")).otherwise(F.when(visual, "visible").otherwise("partial")))
    grade = (F.when(excluded, "unresolved").when(counter, F.when(counted, "A").otherwise("C")).when(clock, F.when(read, "A").otherwise("B"))
             .otherwise(F.when(needs_review, "C").when(visual & F.array_contains(modalities, "experience_bar_change"), "A").otherwise("B")))
    return F.struct(observed.alias("observed"), visibility.alias("visibility"), grade.alias("grade"))


def confidence_method(evidence: Column) -> Column:
    return (F.when(evidence.contains("trajectory"), "trajectory_heuristic").when(evidence.contains("visual"), "visual_disappearance_heuristic")
            .when(evidence.contains("percentage"), "percentage_assist_calibration").when(evidence.contains("xp"), "xp_magnitude_fallback")
            .otherwise("ambiguous_heuristic"))


def inventory_event_type(change: Column, item_type: Column) -> Column:
    change, item_type = F.lower(F.trim(change)), F.lower(F.trim(item_type))
    weapon, passive = item_type == "weapon", item_type == "passive_item"
    return (F.when(change == "evolution", "weapon_evolution").when((change == "new") & weapon, "new_weapon").when((change == "new") & passive, "new_passive_item")
            .when((change == "upgrade") & weapon, "weapon_upgrade").when((change == "upgrade") & passive, "passive_item_upgrade").otherwise("inventory_change"))


def closest_colour(candidates: Sequence[Column], quantity: Column, confidence: Column) -> Column:
    """Tentative colour of an unresolved pickup; the pickup itself stays unresolved."""
    known = [F.when(F.lower(F.trim(c)).isin("blue", "green", "red"), F.lower(F.trim(c))) for c in candidates]
    candidate = F.coalesce(*known)
    assigned = candidate.isNotNull() & (confidence >= CLOSEST_COLOUR_MINIMUM)
    return F.struct(candidate.alias("candidate"), F.when(candidate.isNotNull(), confidence).alias("confidence"),
                    F.when(assigned, quantity).otherwise(0).alias("quantity"), assigned.alias("assigned"))


def bar_acceptance(progress: Column, quality: Column, hud: Column, overlay: Column, blocked: Column, *, min_quality: float = 0.78,
                   min_hud: float = 0.90, max_overlay: float = 0.30) -> Column:
    """Struct ``(value, visibility, grade, reason)``: the reading is kept only when every gate passes."""
    finite = progress.isNotNull() & ~F.isnan(progress)
    clear = finite & (quality >= min_quality)
    ok = clear & ~blocked & (hud >= min_hud) & (overlay < max_overlay)
    covered = overlay >= max_overlay
    reason = (F.when(ok, "quality_and_gameplay_hud_passed").when(blocked, "gameplay_paused").when(covered, "level_up_overlay_present")
              .when(clear, "gameplay_hud_not_confirmed").otherwise("xp_bar_quality_below_threshold"))
    visibility = F.when(ok, "visible").when(blocked | covered | clear, "occluded").otherwise("unknown")
    grade = F.when(ok, "A").when(blocked | covered | clear, "C").otherwise("unresolved")
    return F.struct(F.when(ok, progress).alias("value"), visibility.alias("visibility"), grade.alias("grade"), reason.alias("reason"))


def screen_state(purple: Column, red: Column, lower_red: Column) -> Column:
    return (F.when((purple > 0.45) & (red > 0.08), "results").when((red > 0.30) & (purple > 0.05) & (purple < 0.30) & (lower_red < 0.22), "pregame_menu")
            .when((lower_red > 0.23) & (purple < 0.32), "game_over").otherwise("gameplay_or_overlay"))


def match_label(score: Column, margin: Column, *, high: tuple[float, float], medium: tuple[float, float]) -> Column:
    return (F.when((score >= high[0]) & (margin >= high[1]), "high").when((score >= medium[0]) & (margin >= medium[1]), "medium").otherwise("low"))


def best_matches(scores: DataFrame, keys: Sequence[str], name: str, score: str, *, unknown_below: float, high: tuple[float, float],
                 medium: tuple[float, float]) -> DataFrame:
    """Best and second-best candidate per key with their margin; ties go to the later name.

    The best two are found as the maximum and the maximum of the rest, so no group is sorted in one place.
    """
    top = scores.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), F.col(name).alias("n"))).alias("_best"))
    rest = scores.join(top, list(keys)).filter((F.col(score) != F.col("_best.s")) | (F.col(name) != F.col("_best.n")))
    second = rest.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), F.col(name).alias("n"))).alias("_second"))
    d = top.join(second, list(keys), "left")
    best, runner = F.col("_best.s"), F.coalesce("_second.s", F.lit(-1.0))
    margin = best - runner
    label = match_label(best, margin, high=high, medium=medium)
    return d.select(*keys, F.when(best >= unknown_below, F.col("_best.n")).otherwise("UNKNOWN").alias("match"), F.col("_best.n").alias("suggested"),
                    best.alias("score"), F.coalesce("_second.n", F.lit("")).alias("runner_up"), margin.alias("margin"), label.alias("confidence"),
                    (label == "low").alias("needs_review"))


def selection_exclusion(cursor_score: Column, owned: Column, level: Column, maximum: Column, owned_items: Column, needs_review: Column,
                        cursor_threshold: float = 20.0) -> Column:
    """Why a suggested selection is impossible, or NULL."""
    return (F.when(cursor_score < cursor_threshold, "selection_pointer_unconfirmed").when(owned & maximum.isNotNull() & (level >= maximum), "item_already_at_normal_max")
            .when(~owned & (owned_items >= 6) & needs_review, "low_confidence_beyond_standard_slots"))


def pickup_composition(c: dict[str, Column]) -> Column:
    """Struct ``(blue, green, red, unresolved, evidence, confidence, reasons)`` of one experience update.

    Trajectories outrank disappearances, these outrank a single blue-sized step, and anything else stays unresolved.
    ``c``: ``boundary, full_from_level, trajectories_*, disappeared_*, trajectory_score, disappeared_score, weak_accepted,
    hint, saturated, step_ratio, weak_template``.
    """
    colours = COLOURS[:3]
    tracked = {name: c[f"trajectories_{name}"] for name in colours}
    gone = {name: c[f"disappeared_{name}"] for name in colours}
    total = lambda counts: sum((counts[name] for name in colours[1:]), counts[colours[0]])
    by_track = ~c["boundary"] & (total(tracked) > 0)
    by_sight = ~c["boundary"] & ~by_track & (total(gone) > 0)
    by_step = ~c["boundary"] & ~by_track & ~by_sight & ~c["saturated"] & (c["step_ratio"] <= 1.60)
    open_case = ~c["boundary"] & ~by_track & ~by_sight & ~by_step
    merged = {name: F.when(by_track, F.greatest(tracked[name], gone[name])).when(by_sight, gone[name])
              .when(by_step & F.lit(name == "blue"), 1).otherwise(0).cast("long") for name in colours}
    count = total(merged)
    shown = F.coalesce(*[F.when((c["hint"] == name) & (merged[name] > 0), F.lit(True)) for name in colours], F.lit(False))
    conflict = (by_track | by_sight) & (c["hint"] != "unknown") & ~shown
    weak = by_sight & c["weak_accepted"]
    base = (F.when(by_track, F.least(F.lit(0.98), 0.78 + 0.10 * c["trajectory_score"] + 0.03 * count))
            .when(by_sight, F.least(F.lit(0.98), 0.72 + 0.08 * count + 0.12 * c["disappeared_score"]))
            .when(by_step, 0.48).when(open_case, 0.20).otherwise(0.0))
    confidence = F.when(conflict, F.least(base, F.lit(0.72))).otherwise(base)
    confidence = F.when(weak, F.least(confidence, F.lit(0.68))).otherwise(confidence)
    evidence = (F.when(c["boundary"], "level_up_boundary_pickup_count_unobserved").when(by_track, "visual_trajectory")
                .when(weak, "visual_disappearance_weak").when(by_sight, "visual_disappearance").when(by_step, "xp_single_step_blue_fallback")
                .otherwise("xp_confirmed_color_ambiguous"))
    reasons = F.concat_ws(
        "|", F.when(c["boundary"], F.when(c["full_from_level"], "xp_bar_full_inferred_from_level_change").otherwise("level_up_boundary_needs_visual_review")),
        F.when(by_track & (count > 1), "multiple_trajectory_pickups_in_one_xp_update"), F.when(weak, "weak_visual_candidate_confirmed_by_single_xp_step"),
        F.when(by_sight & (count > 1), "multiple_sprites_disappeared_in_one_xp_update"), F.when(conflict, "visual_color_differs_from_merged_xp_value_band"),
        F.when(by_step, "blue_sized_xp_step_with_hidden_sprite"),
        F.when(open_case, F.when(c["saturated"], "bar_saturated_and_no_disappearing_sprite").otherwise("merged_or_high_value_xp_jump_without_direct_color")),
        F.when(~c["boundary"] & c["weak_template"], "weak_template_match"))
    return F.struct(*[merged[name].alias(name) for name in colours], F.when(open_case, 1).otherwise(0).cast("long").alias("unresolved"),
                    evidence.alias("evidence"), confidence.alias("confidence"), reasons.alias("reasons"))
