"""Bar resets against a frame-by-frame brute force, inside pauses, and with split sessions."""

import random
from statistics import median

import pytest

from sessionlake.operators.counters import bar_resets
from sessionlake.operators.ordering import time_order

FIELDS = "session_id long, t_ms long, event_id long, pixels long, quality double, hud double, overlay double, guarded boolean, reappeared boolean, paused boolean"


def frame(i, pixels, paused=False, hud=0.95, session=1):
    return (session, 40 * i, i, pixels, 0.9, hud, 0.0, paused, False, paused)


def found(spark, rows, limit=None, **options):
    df = spark.createDataFrame(rows, FIELDS)
    out = bar_resets(df, time_order(df, limit=limit), **options)
    return sorted((r.session_id, r.frame, r.t_ms, r.event_id, r.fall_event_id) for r in out.collect())


def brute(rows):
    """Starts of resets of one session, frames counted from 0: every rule read off all its frames."""
    n, width = len(rows), max(1, *(r[3] for r in rows))
    clean = [r[4] >= 0.78 and r[5] >= 0.90 and r[6] < 0.05 and not r[7] for r in rows]
    grown = {i for i in range(1, n) if clean[i] and clean[i - 1] and rows[i][3] > rows[i - 1][3] and not rows[i][8]}
    starts = []
    for i in range(1, n):
        fall = rows[i][3] - rows[i - 1][3] <= -0.20 * width and min(rows[i][5], rows[i - 1][5]) >= 0.90
        fall = fall and max(r[3] for r in rows[max(0, i - 15):i]) >= 0.9 * width and median(r[3] for r in rows[i:i + 5]) <= 0.8 * width
        if fall and (not starts or (i - starts[-1][0] > 15 and grown & set(range(starts[-1][0] + 1, i)))):
            starts.append((max([j + 1 for j in range(i) if not rows[j][9]], default=0), i))
    return [(rows[i][0], b + 1, rows[b][1], rows[b][2], rows[i][2]) for b, i in starts]


def test_reset_inside_a_pause_begins_with_the_pause(spark):
    bar = [*range(60, 100), *[100] * 10, *[0] * 6, *range(1, 30)]
    rows = [frame(i, p, paused=44 <= i < 54) for i, p in enumerate(bar)]
    assert found(spark, rows) == [(1, 45, 40 * 44, 44, 50)]
    assert found(spark, [frame(i, p) for i, p in enumerate(bar)]) == [(1, 51, 2000, 50, 50)]


def test_animation_is_one_reset_and_gates_hold(spark):
    fill = list(range(0, 101, 4))
    flicker = [0, 100] * 20 + [0] * 5
    rows = [frame(i, p) for i, p in enumerate(fill)]
    rows += [frame(len(rows) + i, p, paused=True) for i, p in enumerate(flicker)]
    rows += [frame(len(rows) + i, p) for i, p in enumerate(fill + [0] * 6)]
    want = brute(rows)
    assert found(spark, rows) == want and len(want) == 2
    assert found(spark, [(*r[:5], 0.5, *r[6:]) for r in rows]) == []


@pytest.mark.parametrize("limit", [None, 40])
def test_random_sessions(spark, limit):
    rng, rows, want = random.Random(5), [], []
    for session in range(6):
        own, level, paused = [], 0, False
        for i in range(260):
            level = 0 if level > 96 and rng.random() < 0.4 else min(100, level + rng.choice([0, 2, 5, 9]))
            paused = rng.random() < (0.8 if paused else 0.06)
            shown = level if rng.random() < 0.95 else 0
            own.append((session, 40 * (i // 2), 1000 * session + i, shown, rng.choice([0.7, 0.9, 0.9, 0.95]), rng.choice([0.95] * 9 + [0.8]), rng.choice([0.0, 0.0, 0.2]),
                        paused or rng.random() < 0.05, rng.random() < 0.05, paused))
        rows += own
        want += brute(own)
    assert found(spark, rows, limit) == sorted(want) and len(want) > 10


def test_empty_and_null_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 40 * i, i, None, None, None, None, None, None, None) for i in range(4)]) == []
