"""Small literal cases with known outcomes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.functions.scalars import clock_seconds, interval_bounds, wilson_lower
from sessionlake.operators import binning, clocks, contracts, counters, detections, events, intervals, machines
from sessionlake.operators.inventory import progression
from sessionlake.operators.ordering import time_order


def rows_of(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_run_segmentation(spark):
    seconds = [(s, 0 if s < 11 else s - 10) for s in range(9, 171)] + [(s, 0 if s < 193 else s - 192) for s in range(191, 566)]
    df = spark.createDataFrame([(1, s, s, c) for s, c in seconds], "session_id long, t_ms long, event_id long, clock long")
    out = clocks.gameplay_runs(df, time_order(df), second="t_ms", clock="clock")
    assert rows_of(out, "start_ms", "end_ms") == [(9_000, 171_000), (191_000, 566_000)]


def test_counter_windows(spark):
    df = spark.createDataFrame([(1, 0, 0, 10), (1, 5_000, 1, 15), (1, 10_000, 2, 21)], "session_id long, t_ms long, event_id long, c long")
    out = binning.boundary_windows(df, 10_000, 5_000, value="c")
    assert [r["delta"] for r in out.orderBy("start_ms").collect()] == [5, 6]


def test_missing_counter_stays_missing(spark):
    df = spark.createDataFrame([(1, 6_000, 0, 10)], "session_id long, t_ms long, event_id long, c long")
    out = binning.boundary_windows(df, 15_000, 5_000, value="c").orderBy("start_ms").collect()
    assert [r["delta"] for r in out] == [None, None, None]
    assert [r["observed"] for r in out] == [False, False, False]


def test_half_open_bins(spark):
    df = spark.createDataFrame([(1, 4_999), (1, 5_000), (1, 9_999)], "session_id long, t_ms long")
    out = binning.count_by_bin(df, 5_000, {"n": F.lit(True)})
    assert rows_of(out, "start_ms", "n") == [(0, 1), (5_000, 2)]


def test_centred_mean(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0), (1, 5_000, 1, 3.0)], "session_id long, t_ms long, event_id long, v double")
    assert [r["mean"] for r in binning.centered_mean(df, time_order(df), value="v").collect()] == [2.0, 2.0]


def test_span_status(spark):
    windows = spark.createDataFrame([(1, i, 100, s, e) for i, (s, e) in enumerate([(0, 10), (10, 20), (30, 40), (90, 110), (100, 120)])],
                                    "session_id long, window_id long, duration_ms long, start_ms long, end_ms long")
    gaps = spark.createDataFrame([(1, 0, 20, 35)], "session_id long, event_id long, start_ms long, end_ms long")
    out = intervals.span_status(windows, gaps, duration="duration_ms")
    assert [r["status"] for r in out.orderBy("window_id").collect()] == ["span-only", "span-only", "gap", "partial", "absent"]


def test_clock_spikes_do_not_cascade(spark):
    texts = ["00:01", "00:02", "09:59", "00:03", "00:04", None, "00:99", "x", "00:05"]
    df = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(texts)], "session_id long, t_ms long, event_id long, raw string")
    out = {r["event_id"]: r["status"] for r in clocks.clock_quality(df, time_order(df), "raw", 1_200_000).collect()}
    assert [out[i] for i in range(9)] == ["accepted", "accepted", "rejected", "accepted", "accepted", "missing", "rejected", "rejected", "accepted"]


def test_clock_texts(spark):
    df = spark.createDataFrame([("01:02:03",), ("75:30",), ("1:2:3:4",), ("",)], "t string").select("t", clock_seconds(F.col("t")).alias("c"))
    assert {r["t"]: tuple(r["c"]) for r in df.collect()} == {
        "01:02:03": (3723, None), "75:30": (4530, None), "1:2:3:4": (None, "invalid_clock_format"), "": (None, "missing_ocr")}


def test_interval_labels(spark):
    df = spark.createDataFrame([("0:05-0:10",), ("1:00 – 1:05",), ("later",)], "t string").select(interval_bounds(F.col("t")).alias("i"))
    assert [tuple(r["i"]) for r in df.collect()] == [(5.0, 10.0, 5.0), (60.0, 65.0, 5.0), (None, None, None)]


def test_wilson(spark):
    value = spark.range(1).select(wilson_lower(F.lit(19), F.lit(20)).alias("w")).first()["w"]
    assert abs(value - 0.76387) < 1e-4


def test_closest_colour_needs_confidence(spark):
    df = spark.range(1).select(contracts.closest_colour([F.lit("blue")], F.lit(2), F.lit(0.24)).alias("c")).first()["c"]
    assert (df["candidate"], df["quantity"], df["assigned"]) == ("blue", 0, False)


def test_interruption_cannot_create_a_gain(spark):
    data = [(1, 0, 0, 100, True), (1, 500, 1, None, False), (1, 1_000, 2, 140, True), (1, 1_500, 3, 140, True), (1, 2_000, 4, 150, True), (1, 2_500, 5, 150, True)]
    df = spark.createDataFrame(data, "session_id long, t_ms long, event_id long, v long, usable boolean").withColumns({"seg": F.lit(0), "c": F.lit(0.9)})
    out = events.confirmed_gains(df, time_order(df), "v", "usable", "seg", "c")
    assert rows_of(out, "event_id", "quantity") == [(4, 10)]


def test_menu_drops(spark):
    data = [(1, i, i, v) for i, v in enumerate([5, 5, 3, 5, 4, 4, 6, 4, 2])]
    df = spark.createDataFrame(data, "session_id long, t_ms long, event_id long, v long")
    out = counters.confirmed_drops(df, time_order(df), "v")
    assert rows_of(out, "event_id", "counter_before", "counter_after", "confirmed") == [(4, 5, 4, True), (8, 4, 2, False), (8, 4, 2, False)]


FRAGMENTS = [
    ([(0, 2, ["level_up_transition"], [2]), (3, 10, ["level_up_menu"], [7])], 1),
    ([(0, 8, ["level_up_menu"], [8]), (9, 20, ["level_up_menu"], [11])], 2),
    ([(0, 8, ["treasure_menu"], [8]), (14, 20, ["treasure_transition"], [6])], 1),
    ([(0, 8, ["treasure_menu"], [8]), (17, 20, ["treasure_transition"], [3])], 2),
    ([(0, 5, ["level_up_transition", "level_up_menu"], [3, 2]), (8, 20, ["level_up_menu"], [12])], 1),
    ([(0, 5, ["level_up_transition", "level_up_menu"], [2, 3]), (8, 20, ["level_up_menu"], [12])], 2),
    ([(0, 20, ["level_up_menu"], [20]), (23, 27, ["level_up_transition"], [4])], 1),
]


@pytest.mark.parametrize("parts, merged", FRAGMENTS)
def test_fragment_merging(spark, parts, merged):
    df = spark.createDataFrame([(1, *p) for p in parts], "session_id long, start_frame long, end_frame long, phases array<string>, phase_frames array<long>")
    out = intervals.merge_fragments(df, time_order(df, by=("start_frame", "end_frame")), 30.0)
    assert out.count() == merged


def second(index, *texts, out=False, confidence=0.9):
    return (index, [(i, text, confidence) for i, text in enumerate(texts)], out)


def run_sequence(records, start=None):
    state = {"core": {"value": start, "seen": False, "gap": 0}, "wait": []}
    out = []
    for record in records:
        state, made = machines.sequence_step(state, record)
        out += made
    return [(value, status) for _, _, _, value, status, _ in out + machines.sequence_finish(state)]


def test_overshoot_is_rejected():
    records = [second(0, "100", "100"), second(1, "160", "160"), second(2, "101", "101"), second(3, "102", "102"), second(4, "103", "103")]
    assert run_sequence(records) == [(100, "observed"), (100, "rejected_temporal_overshoot"), (101, "observed"), (102, "observed"), (103, "observed")]


def test_one_lower_second_is_not_enough():
    records = [second(0, "100", "100"), second(1, "110", "110"), second(2, "101", "101"), second(3, "112", "112")]
    assert run_sequence(records)[1] == (110, "observed")


def test_gap_jump_needs_two_confirmations():
    blank = [second(i) for i in range(1, 31)]
    jump = [second(0, "100", "100"), *blank, second(31, "230", "230")]
    assert run_sequence(jump)[-1] == (100, "unconfirmed_gap_jump")
    assert run_sequence([*jump, second(32, "231", "231"), second(33, "232", "232")])[31] == (230, "observed")


def test_pause_keeps_the_baseline():
    records = [second(0, "100", "100"), second(1, "5", out=True), second(2, "101", "101")]
    assert run_sequence(records) == [(100, "observed"), (None, "excluded_level_up_pause"), (101, "observed")]


def test_stray_digits():
    assert machines.pick_reading([(0, "266", 0.9)], 26)[0] == 26 or machines.pick_reading([(0, "266", 0.9)], 26) is None
    assert machines.readable_value("1237", 237, 75, set()) == 237
    assert machines.readable_value("140", 138, 75, set()) == 140
    assert machines.pick_reading([(0, "14", 0.9), (1, "140", 0.9)], 14)[0] == 14


def test_assignment_matches_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        n, m = rng.randint(1, 4), rng.randint(1, 5)
        cost = [[rng.random() for _ in range(m)] for _ in range(n)]
        chosen = detections.cheapest_assignment(cost)
        pairs = [(i, j) for i, j in enumerate(chosen) if j >= 0]
        assert len({j for _, j in pairs}) == len(pairs) == min(n, m)
        total = sum(cost[i][j] for i, j in pairs)
        if n <= m:
            best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(cost[p[j]][j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert abs(total - best) < 1e-9


def test_track_is_cut_by_an_interruption(spark):
    data = [(1, 0, "egg", 0, 10.0, 10.0, 0.9), (1, 1, "egg", 500, 20.0, 10.0, 0.9), (1, 2, "egg", 1_000, 30.0, 10.0, 0.9), (1, 3, "egg", 1_500, 40.0, 10.0, 0.9)]
    df = spark.createDataFrame(data, "session_id long, det_id long, code string, t_ms long, x double, y double, score double")
    none = spark.createDataFrame([], "session_id long, t_ms long")
    stop = spark.createDataFrame([(1, 1_000)], "session_id long, t_ms long")
    assert {r["track_id"] for r in detections.tracks(df, none).collect()} == {0}
    assert rows_of(detections.tracks(df, stop), "det_id", "track_id") == [(0, 0), (1, 0), (3, 3)]


def test_evolution_retires_its_base(spark):
    data = [(1, i, i, "weapon", change, source, before, after, None) for i, (change, source, before, after) in enumerate([
        ("initial_state", "initial_state", "", "Whip"), ("upgrade", "level_up", "", "Whip"), ("evolution", "chest", "Whip", "Bloody Tear"), ("upgrade", "level_up_retrospective", "", "Whip")])]
    df = spark.createDataFrame(data, "session_id long, t_ms long, event_id long, item_type string, change string, source string, item_before string, item_after string, configured_level long")
    out = progression(df, time_order(df))
    assert rows_of(out, "event_id", "event_type", "level_after") == [(0, "initial_state", 1), (1, "upgrade", 2), (2, "evolution", 1)]


def test_levels_must_follow(spark):
    data = [(1, i, i, a, b) for i, (a, b) in enumerate([(1, 2), (5, 6), (2, 3), (None, 4), (3, 4), (6, 7)])]
    df = spark.createDataFrame(data, "session_id long, t_ms long, event_id long, from_level long, to_level long")
    out = events.accepted_levels(df, time_order(df), 1)
    assert {r["event_id"]: r["acceptance"] for r in out.collect()} == {0: "exact", 1: "unresolved", 2: "exact", 3: "first_visible", 5: "after_gap"}


def test_windows_hold_late_sessions(spark):
    """Without a recorded length a session lasts to the bin of its last sample, however late that is."""
    late = 100 * 86_400_000
    df = spark.createDataFrame([(1, 1_000, 1, 5), (1, late + 12_000, 2, 9), (2, 4_999, 3, 7)], "session_id long, t_ms long, event_id long, c long")
    windows = binning.boundary_windows(df, None, 5_000, value="c")
    ends = {r["session_id"]: r["e"] for r in windows.groupBy("session_id").agg(F.max("end_ms").alias("e")).collect()}
    assert ends == {1: late + 15_000, 2: 5_000}
    assert windows.filter("session_id = 1 AND delta = 4").first()["start_ms"] == late + 10_000
