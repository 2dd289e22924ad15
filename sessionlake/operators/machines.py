"""Acceptance machines for counters: pure step functions shared by batch folds and streams."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.operators.folds import session_fold
from sessionlake.operators.ordering import TimeOrder, time_order

# fixed values: limits of the per-second counter
LOOKAHEAD_S, SUPPORT_S, SUPPORT_SAMPLES = 7, 2, 2
LARGE_RISE, LARGE_SHARE, LARGE_LOOKAHEAD_S, LARGE_CONFIDENCE = 30, 0.10, 20, 0.5
GAP_PER_SECOND, GAP_CAP, GAP_CONFIRM_S, GAP_CONFIDENCE = 2, 200, 10, 0.3

# fixed values: limits of the sampled coin counter
COIN_MAX_RISE, FEVER_MAX_RISE, FEVER_CONFIDENCE, REPEAT_MS = 2_000, 500, 0.95, 2_000

COIN_FIELDS = "event_id long, t_ms long, candidate long, accepted long, reason string"
COIN_COLUMNS = ["event_id", "t_ms", "paused", "fever", "candidate", "confidence"]


def jump_limit(previous: int) -> int:
    return max(75, int(previous * 0.15))


def readable_value(digits: str, previous: int | None, limit: int, seen: set[str]) -> int:
    """Value of a reading, with stray digits at either end taken off where the counter's past calls for it."""
    value = int(digits)
    if previous is None:
        return value
    fits = lambda text: previous <= int(text) <= previous + limit
    heads = [digits[:n] for n in range(1, len(digits))]
    backed = [int(head) for head in heads if head in seen and fits(head)]
    if backed:
        return min(backed)
    if value - previous <= limit:
        return value
    tails = [digits[n:] for n in range(1, len(digits))]
    return min((int(part) for part in tails + heads if fits(part)), default=value)


def pick_reading(candidates, previous: int | None, limit: int | None = None, floor: float = 0.0):
    """``(value, confidence, samples)`` of one second, or None: best reading per sample, then the lower median.

    ``candidates`` are ``(sample, digits, confidence)`` in reading order.
    """
    limit = limit or (jump_limit(previous) if previous is not None else 0)
    seen = {digits for _, digits, _ in candidates if digits}
    best: dict = {}
    for sample, digits, confidence in candidates:
        if not digits or confidence < floor:
            continue
        value = readable_value(digits, previous, limit, seen)
        if previous is not None and (value < previous or (previous > 10 and value - previous > limit)):
            continue
        if sample not in best or confidence > best[sample][1]:
            best[sample] = (value, confidence)
    if not best:
        return None
    values = sorted(value for value, _ in best.values())
    middle = values[(len(values) - 1) // 2]
    return middle, max(c for v, c in best.values() if v == middle), len(best)


def select_step(previous, row):
    """One second on its own: take a plausible reading or carry the last value."""
    second, candidates, excluded = row
    if excluded:
        return previous, [(second, None, None, None, "excluded_level_up_pause", 0)]
    found = pick_reading(candidates, previous)
    if found is None:
        return previous, [(second, None, None, previous, "missing" if previous is None else "carried_forward", 0)]
    value, confidence, samples = found
    return value, [(second, value, confidence, value, "observed", samples)]


def decide_second(state: dict, record, future) -> tuple[dict, tuple]:
    """Accept, hold or reject the reading of one second given the seconds after it (bounded look-ahead)."""
    second, candidates, excluded = record
    previous = state["value"]
    if excluded:
        return state, (second, None, None, None, "excluded_level_up_pause", 0)
    gap = state["gap"] if state["seen"] else 0
    base = jump_limit(previous) if previous is not None else None
    limit = max(base, min(GAP_CAP, base + GAP_PER_SECOND * gap)) if base is not None else None
    found = pick_reading(candidates, previous, limit)
    status = "observed"
    if found is None:
        status = "missing" if previous is None else "carried_forward"
    elif previous is not None and found[0] > previous:
        value = found[0]
        if value - previous > base:
            confirmations = sum(1 for _, later, out in future[:GAP_CONFIRM_S] if not out and pick_reading(later, value, None, GAP_CONFIDENCE))
            if confirmations < 2:
                status = "unconfirmed_gap_jump"
        if status == "observed":
            large = value - previous >= max(LARGE_RISE, math.ceil(previous * LARGE_SHARE))
            short = long = 0
            for distance, (_, later, out) in enumerate(future[:max(LOOKAHEAD_S, LARGE_LOOKAHEAD_S if large else 0)], start=1):
                lower = None if out else pick_reading(later, previous)
                if lower is None or not previous <= lower[0] < value:
                    continue
                short += distance <= LOOKAHEAD_S and lower[2] >= SUPPORT_SAMPLES
                long += large and lower[1] >= LARGE_CONFIDENCE
                if short >= SUPPORT_S or long >= SUPPORT_S:
                    status = "rejected_temporal_overshoot"
                    break
    if status == "observed":
        value, confidence, samples = found
        return {"value": value, "seen": True, "gap": 0}, (second, value, confidence, value, status, samples)
    return {**state, "gap": state["gap"] + 1}, (second, None, None, previous, status, found[2] if found else 0)


def sequence_step(state, row):
    """Delay every second until its look-ahead has arrived; the buffer never exceeds the look-ahead."""
    state = state or {"core": {"value": None, "seen": False, "gap": 0}, "wait": []}
    wait = state["wait"] + [list(row)]
    out = []
    core = state["core"]
    if len(wait) > LARGE_LOOKAHEAD_S:
        core, made = decide_second(core, wait[0], wait[1:])
        out, wait = [made], wait[1:]
    return {"core": core, "wait": wait}, out


def sequence_finish(state):
    if not state:
        return []
    core, wait, out = state["core"], state["wait"], []
    while wait:
        core, made = decide_second(core, wait[0], wait[1:])
        out.append(made)
        wait = wait[1:]
    return out


READING_COLUMNS = ["first", "sample", "digits", "confidence", "excluded"]


def distinct_readings(readings: DataFrame, key: str, second: str, *, sample: str, text: str, confidence: str, excluded: str, tie: str) -> DataFrame:
    """One row per second, sample and digits: the best confidence, the first tie-breaker, and whether any such reading was excluded."""
    digits = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^0-9]", "")
    return readings.groupBy(key, second, F.col(sample).alias("sample"), digits.alias("digits")).agg(
        F.min(tie).alias("first"), F.max(confidence).alias("confidence"), F.bool_or(excluded).alias("excluded"))


def by_second(step):
    """A step over seconds as a step over single readings `(second, first, sample, digits, confidence, excluded)` in order of seconds.

    The state holds the readings of one second, the best for each sample and digits, and the state of the inner step."""

    def settle(state):
        listed = sorted(state["open"].values(), key=lambda r: r[0])
        inner, out = step(state["inner"], (state["second"], [tuple(r[1:]) for r in listed], state["excluded"]))
        return {"inner": inner, "second": None, "open": {}, "excluded": False}, out

    def run(state, row):
        second, first, sample, digits, confidence, excluded = row
        state = state or {"inner": None, "second": None, "open": {}, "excluded": False}
        out = []
        if state["second"] is not None and state["second"] != second:
            state, out = settle(state)
        name = f"{sample} {digits}"
        known = state["open"].get(name)
        best = [first, sample, digits, confidence] if known is None else [min(first, known[0]), sample, digits, max(confidence, known[3])]
        return {**state, "second": second, "open": {**state["open"], name: best}, "excluded": bool(state["excluded"] or excluded)}, out

    def finish(state, inner_finish=None):
        if not state:
            return []
        out = []
        if state["second"] is not None:
            state, out = settle(state)
        return [*out, *(inner_finish(state["inner"]) if inner_finish else [])]

    return run, finish


select_reading, select_finish = by_second(select_step)
sequence_reading, _sequence_end = by_second(sequence_step)


def sequence_reading_finish(state):
    return _sequence_end(state, sequence_finish)


SECOND_FIELDS = "second long, observed_value long, confidence double, state_value long, status string, valid_candidates long"


def selected_counter(readings: DataFrame, key: str, second: str) -> DataFrame:
    """``readings`` from ``distinct_readings``."""
    order = time_order(readings, key, (second, "first"))
    return session_fold(readings, order, [second, *READING_COLUMNS], select_reading, SECOND_FIELDS, finish=select_finish).withColumnRenamed("second", second)


def selected_sequence(readings: DataFrame, key: str, second: str) -> DataFrame:
    """``readings`` from ``distinct_readings``."""
    order = time_order(readings, key, (second, "first"))
    return session_fold(readings, order, [second, *READING_COLUMNS], sequence_reading, SECOND_FIELDS, finish=sequence_reading_finish).withColumnRenamed("second", second)


def changed_selections(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds whose selection the sequence rule changed, with the review flag of the new one."""
    old = before.select(*keys, F.struct("state_value", "status").alias("_old"))
    new = after.select(*keys, "state_value", "status", F.struct("state_value", "status").alias("_new"))
    return new.join(old, keys).filter(~F.col("_new").eqNullSafe(F.col("_old"))).select(
        *keys, F.col("_old.state_value").alias("old_value"), F.col("_old.status").alias("old_status"), "state_value", "status", (F.col("status") != "observed").alias("review"))


class Handling(NamedTuple):
    """What a kind of sample does: the reason it is published with, whether the counter shows its confirmed value, the memory it
    needs (a first sighting is remembered there, a second one confirms it) with the reason of a confirmation, and memories it clears."""

    reason: str | None = None
    shows: bool = False
    memory: str | None = None
    confirmed_reason: str | None = None
    clears: tuple[str, ...] = ()


# memories: how far above the remembered value a second sighting may lie
COIN_MEMORY = {"repeat": 0, "surge": FEVER_MAX_RISE}

COIN_HANDLING = {
    "blocked": Handling("excluded_from_gameplay", clears=("repeat", "surge")),
    "blank": Handling(clears=("surge",)),
    "blank in fever": Handling(),
    "lower": Handling("counter_decrease_rejected"),
    "equal": Handling(shows=True, clears=("repeat", "surge")),
    "misread": Handling("leading_digit_ocr_artifact_removed_from_confirmed_counter", shows=True, clears=("repeat", "surge")),
    "too high": Handling("implausible_counter_jump_rejected"),
    "doubtful in fever": Handling("gold_fever_counter_candidate_rejected"),
    "higher": Handling("counter_change_awaiting_repeat_confirmation", memory="repeat", clears=("repeat",)),
    "higher in fever": Handling("gold_fever_counter_awaiting_monotonic_confirmation", memory="surge", confirmed_reason="gold_fever_monotonic_confirmation", clears=("repeat", "surge")),
}


def digit_misread(candidate: int, confirmed: int) -> bool:
    """Whether a higher candidate reads as the confirmed number with one digit put before or behind it, or with another first character."""
    read, known = str(candidate), str(confirmed)
    if len(read) == len(known) + 1:
        return read.startswith(known) or read.endswith(known)
    return len(read) == len(known) > 1 and read[0] != known[0] and read[1:] == known[1:]


def coin_kind(value: int | None, sample: tuple) -> str:
    """Kind of one sample against the confirmed value."""
    _, _, paused, fever, candidate, confidence = sample
    if paused:
        return "blocked"
    if candidate is None:
        return "blank in fever" if fever else "blank"
    if value is None:
        return "higher"
    rise = candidate - value
    if rise <= 0:
        return "lower" if rise else "equal"
    misread = digit_misread(candidate, value)
    if fever:
        sure = confidence is not None and confidence >= FEVER_CONFIDENCE
        return "higher in fever" if sure and not misread and rise <= FEVER_MAX_RISE else "doubtful in fever"
    if rise > COIN_MAX_RISE:
        return "too high"
    return "misread" if misread else "higher"


def coin_step(state, sample):
    """One sample of the coin counter. State: the confirmed value, and for each memory the value and time of a first sighting."""
    state = state or {"value": None}
    ident, t, _, _, candidate, _ = sample
    value = state["value"]
    rule = COIN_HANDLING[coin_kind(value, sample)]
    reason, shown = rule.reason, value if rule.shows else None
    cleared = rule.clears
    if rule.memory:
        first, at = state.get(rule.memory) or (None, None)
        if first is not None and t - at <= REPEAT_MS and 0 <= candidate - first <= COIN_MEMORY[rule.memory]:
            value = shown = candidate
            reason = rule.confirmed_reason
        else:
            state, cleared = {**state, rule.memory: [candidate, t]}, ()
    kept = {name: seen for name, seen in state.items() if name not in cleared}
    return {**kept, "value": value}, [(ident, t, candidate, shown, reason)]


def coin_deadline(state) -> int | None:
    """Time from which the oldest first sighting can confirm nothing."""
    times = [state[name][1] for name in COIN_MEMORY if state and state.get(name)]
    return min(times) + REPEAT_MS + 1 if times else None


def coin_forget(state, now: int):
    """The state without first sightings that are too old at `now`; nothing is published for them."""
    return {name: seen for name, seen in state.items() if name == "value" or now - seen[1] <= REPEAT_MS}, []


def coin_counter(samples: DataFrame, order: TimeOrder) -> DataFrame:
    return session_fold(samples, order, COIN_COLUMNS, coin_step, COIN_FIELDS)


def level_chain(rows: DataFrame, order: TimeOrder) -> DataFrame:
    """Level of every pickup: an accepted reading, else the last accepted one, else the count of resets.

    ``rows``: ``raw_level, valid, boundary, before_level, after_level, inferred_level``; a confirmed boundary (one level
    up) also sets the last accepted level.
    """

    def step(last, row):
        ident, raw, valid, boundary, before, after, inferred, why = row
        if boundary:
            confirmed = before is not None and after is not None and after == before + 1
            return (after if confirmed else last), [(ident, before if confirmed else inferred, "hud_ocr_level_change" if confirmed else "boundary_pattern_pending_review",
                                                     "accepted_level_up_boundary" if confirmed else "level_up_boundary_needs_visual_review")]
        if valid and last is not None and raw < last:
            valid, why = False, "ocr_temporal_decrease"
        if valid:
            return raw, [(ident, raw, "hud_ocr", why)]
        if last is not None:
            return last, [(ident, last, "previous_hud_ocr_fallback", why)]
        return last, [(ident, inferred, "reset_inference_fallback", why)]

    tie = order.by[-1]
    return session_fold(rows, order, [tie, "raw_level", "valid", "boundary", "before_level", "after_level", "inferred_level", "validation"], step,
                        f"{tie} long, hud_level long, level_source string, validation string")


def level_gates(rows: DataFrame, order: TimeOrder, *, min_confidence: float = 0.45, lead: int = 8, lag: int = 2, lookahead: int = 6) -> DataFrame:
    """Validity of level readings: text, confidence and distance gates, then isolated high readings."""
    c = F.col
    reason = (F.when(c("raw_level").isNull(), "ocr_missing").when(c("confidence") < min_confidence, "ocr_low_confidence").when(~c("raw_text").startswith("LV"), "ocr_missing_lv_prefix")
              .when(c("raw_level") > c("inferred_level") + lead, "ocr_too_far_ahead_of_reset_count")
              .when(c("raw_level") < F.greatest(F.lit(1), c("inferred_level") - lag), "ocr_too_far_behind_reset_count").otherwise("accepted"))
    d = rows.withColumn("_gate", reason)
    ok = F.when(c("_gate") == "accepted", c("raw_level"))
    d = order.frames(order.tag(d.withColumn("_ok", ok)), lookahead, _ahead=lambda w: F.collect_list("_ok").over(w.rowsBetween(1, lookahead)))
    return order.untag(d)


def without_spikes(gated: DataFrame) -> DataFrame:
    """Reject a reading when two of the next valid ones are lower; earlier rejections do not change later ones."""
    c = F.col
    lower = F.size(F.filter("_ahead", lambda level: level < c("raw_level")))
    spike = (c("_gate") == "accepted") & (lower >= 2)
    valid = (c("_gate") == "accepted") & ~spike
    return gated.withColumns({"valid": valid, "validation": F.when(spike, "ocr_temporal_spike").otherwise(c("_gate"))}).drop("_gate", "_ok", "_ahead")
