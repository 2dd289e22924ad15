"""Cases that only tables larger than the smallest ones hold."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sessionlake.operators.machines import digit_misread
from sessionlake.streaming.machines import STATE_STORE_CONF, track_stream
from sessionlake.streaming.windows import gap_sessions, with_event_time
from tests.compare import difference
from tests.test_streaming import feed, run

FOLDER = "/root/testdata/sf0.1"
OTHER_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def same_for(spark, name, users, folder):
    """The query against its SQL over the events of a few users."""
    spark.read.parquet(f"{FOLDER}/events.parquet").filter(F.col("user_id").isin(*users)).write.parquet(f"{folder}/spark")
    import duckdb

    duckdb.sql(f"COPY (SELECT * FROM read_parquet('{folder}/spark/*.parquet')) TO '{folder}/events.parquet' (FORMAT parquet)")
    assert difference(spark, entry.queries()[name], entry.oracle_sql()[name], folder) is None


def test_digits_of_a_negative_counter():
    assert not digit_misread(780, -20)
    assert digit_misread(520, -20)
    assert digit_misread(1500, 500) and digit_misread(5003, 500) and digit_misread(700, 500) and not digit_misread(7, 5) and not digit_misread(510, 500)


@needs_tables
def test_coins_below_zero(spark, tmp_path):
    same_for(spark, "coin_machine", [135], str(tmp_path))


@needs_tables
def test_replaced_choice_at_its_maximum(spark, tmp_path):
    """A choice is first replaced, then found to be at its maximum by a replacement before it."""
    same_for(spark, "inventory_build", [679, 391, 189], str(tmp_path))


def test_events_a_whole_gap_apart_are_two_sessions(spark):
    df = with_event_time(spark.createDataFrame([(1, 0), (1, 9_999), (1, 19_999), (1, 29_998)], "session_id long, t_ms long"))
    got = gap_sessions(df, "10 seconds", ["session_id"]).collect()
    assert sorted((r.start_ms, r.last_ms, r.events) for r in got) == [(0, 9_999, 2), (19_999, 29_998, 2)]


@pytest.mark.parametrize("name", ["stream_coin_machine", "stream_late_rows", "stream_tracks"])
def test_machines_in_a_session_with_another_state_store(spark, name):
    """A session that names no store has Spark's default one, which machines cannot use."""
    folder, before = "/root/testdata/sf0.001", spark.conf.get(STATE_STORE_CONF)
    if not os.path.isdir(folder):
        pytest.skip("tables not present")
    spark.conf.set(STATE_STORE_CONF, OTHER_STORE)
    try:
        if name in entry.oracle_sql():
            assert difference(spark, entry.queries()[name], entry.oracle_sql()[name], folder) is None
        else:
            assert entry.queries()[name](spark, folder).count() > 0
        assert spark.conf.get(STATE_STORE_CONF) == OTHER_STORE
    finally:
        spark.conf.set(STATE_STORE_CONF, before)


def test_slots_of_an_order_without_a_join(spark, tmp_path):
    """Memory of a task holds one row per slot, not the rows beside their orders' last slots."""
    rows = [(1, 1, 0.0, 0.0, 1.0), (1, 2, 0.09, 0.0, 1.0), (1, 2, 0.0, 0.0, 1.0), (1, 3, 0.0, 0.0, 1.0), (2, 1, 0.0, 0.0, 1.0), (2, None, 0.0, 0.0, 50.0), (None, 1, 0.09, 0.0, 1.0), (3, 4, None, None, 45.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double, l_tax double, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = entry.queries()["slot_occupancy"](spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 1, True), (1, 2, True), (1, 3, False), (2, 1, False), (2, None, None), (3, 4, True)], key=repr)


def test_interruptions_end_tracks_of_any_number_of_codes(spark, tmp_path):
    """1,126 codes, none among them, each seen in the frame before an interruption and in the one after; detection 0 has no place and meets an interruption."""
    near = [0.1, 0.1, 0.5]
    rows = [(0, 0, None), (1, 0, near), (2, 0, near)]
    for k in range(1, 126):
        rows += [(110 * k + shift + i, 9 * k + i, near) for shift in (-10, 11) for i in range(9)] + [(110 * k + i, 9 * k, near) for i in range(3)]
    rows += [(110 * k + i, None, near) for k, i in ((130, -10), (130, 0), (130, 1), (130, 2), (130, 11))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = entry.queries()["stream_tracks"](spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()), key=repr)
    assert len(got) == 2 * 9 * 125 + 2 and all(row[2] == row[3] for row in got)
    assert got == sorted(map(tuple, entry.queries()["tracks"](spark, str(tmp_path)).select(out.columns).collect()), key=repr)


def test_interruptions_of_listed_codes_alone(spark, tmp_path):
    rows = [(1, code, i, t, 5.0, 5.0, 0.5) for i, (code, t) in enumerate((code, t) for code in ("a", "b", None) for t in (0, 500, 1_000))]
    df = spark.createDataFrame(rows, "session_id long, code string, det_id long, t_ms long, x double, y double, score double")
    stops = spark.createDataFrame([(1, 500, 0)], "session_id long, t_ms long, n int")
    for number, (codes, cut) in enumerate(((["a"], {"a"}), ([None, "b"], {None, "b"}), ([], set()), (None, {"a", "b", None}))):
        folder = f"{tmp_path}/{number}"
        out = run(track_stream(feed(spark, df, f"{folder}/in"), feed(spark, stops, f"{folder}/stops"), codes), f"listed_{number}").filter("session_id >= 0")
        whole = {(code, i if code in cut else 3 * (i // 3)) for i, (_, code, *_) in enumerate(rows) if not (code in cut and i % 3 == 1)}
        assert {(r.code, r.track_id) for r in out.collect()} == whole and out.count() == 9 - len(cut)
