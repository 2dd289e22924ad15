"""Streams give what the batch operators give."""

import time

from pyspark.sql import functions as F

from sessionlake.operators import counters, detections, machines
from sessionlake.operators.binning import count_by_bin
from sessionlake.operators.machines import coin_counter
from sessionlake.operators.ordering import time_order
from sessionlake.streaming.machines import COIN, PLAUSIBLE, SELECT, SEQUENCE, LateRows, Machine, candidate_stream, reading_stream, run_machine, track_stream
from sessionlake.streaming.windows import binned_counts, distinct_events, gap_sessions, with_event_time


def write_parts(spark, df, folder, parts=3):
    """Files in time order, so that every micro-batch brings the next stretch of time."""
    last = df.agg(F.max("t_ms")).first()[0] + 1
    for i in range(parts):
        low, high = last * i // parts, last * (i + 1) // parts
        df.filter((F.col("t_ms") >= low) & (F.col("t_ms") < high)).coalesce(1).write.mode("append").parquet(folder)


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def samples(spark):
    data = [(s, t * 500, s * 1000 + t, t % 37 == 5, t % 60 > 45, None if t % 17 == 0 else (t // 8) * 5 + (3_000 if t % 29 == 0 else 0), 0.97) for s in (1, 2) for t in range(200)]
    return spark.createDataFrame(data, "session_id long, t_ms long, event_id long, paused boolean, fever boolean, candidate long, confidence double")


def feed(spark, df, folder, late=None):
    """A stream of three stretches of time, each shuffled, then a row far ahead that moves the watermark past everything, then late rows."""
    write_parts(spark, df.orderBy(F.rand(1)), folder)
    end = df.limit(1).withColumns({"session_id": F.lit(-1).cast("long"), "t_ms": F.lit(50_000_000).cast("long")}).select(df.columns)
    end.coalesce(1).write.mode("append").parquet(folder)
    if late is not None:
        late.coalesce(1).write.mode("append").parquet(folder)
    end.withColumn("t_ms", F.lit(90_000_000).cast("long")).select(df.columns).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def same(stream, batch):
    left = sorted((tuple(r) for r in stream.collect() if r.session_id >= 0), key=repr)
    assert left and left == sorted(map(tuple, batch.collect()), key=repr)


def test_coin_machine(spark, tmp_path):
    df = samples(spark)
    out = run(run_machine(feed(spark, df, str(tmp_path / "in")), COIN, ["session_id"], ["event_id"]), "coin_stream")
    same(out, coin_counter(df, time_order(df)))


def readings(spark):
    text = lambda t, i: ["x", str(t // 3), f"{t // 3}0", f"7{t // 3}", str(t // 2), str(t // 3), None][(t * 5 + i * 3) % 7]
    data = [(s, t * 1000 + i * 50, t, s * 100_000 + t * 10 + i, i % 3, text(t, i), (t * 7 + i) % 10 / 10, t % 23 == 4) for s in (1, 2) for t in range(120) for i in range(5)]
    return spark.createDataFrame(data, "session_id long, t_ms long, sec long, event_id long, sample_no long, text string, c double, x boolean")


def test_counter_of_every_second(spark, tmp_path):
    df = readings(spark)
    names = dict(sample="sample_no", text="text", confidence="c", excluded="x", tie="event_id")
    distinct = machines.distinct_readings(df, "session_id", "sec", **names)
    stream = reading_stream(feed(spark, df, str(tmp_path / "in")), second="sec", **names)
    same(run(run_machine(stream, SELECT, ["session_id"], ["first"]), "select_stream"), machines.selected_counter(distinct, "session_id", "sec"))
    whole = machines.selected_sequence(distinct, "session_id", "sec")
    same(run(run_machine(stream, SEQUENCE, ["session_id"], ["first"]), "sequence_stream"), whole)
    assert whole.filter("sec >= 100").count() == 40  # the last look-ahead comes out when the session ends


def test_plausible_counter(spark, tmp_path):
    df = readings(spark).withColumn("v", F.regexp_replace(F.col("text"), "[^0-9]", "").try_cast("long")).withColumn("c", F.col("sec") % 10 / 10)
    stream = candidate_stream(feed(spark, df, str(tmp_path / "in")), second="sec", value="v", confidence="c")
    same(run(run_machine(stream, PLAUSIBLE, ["session_id"], ["value", "event_id"]), "plausible_stream"),
         counters.plausible_counter(df, "session_id", "sec", "v", "c", "event_id"))


def test_tracks(spark, tmp_path):
    data = [(s, code, s * 10_000 + code * 1000 + t * 4 + i, t * 250, float(i * 60 + t * 9 % 50 + code), float(t * 13 % 40), 0.5 + (t * 7 + i * 3) % 10 / 20) for s in (1, 2) for code in (0, 1, 2) for t in range(80) if t % 9 for i in range(3)]
    df = spark.createDataFrame(data, "session_id long, code int, det_id long, t_ms long, x double, y double, score double")
    stops = spark.createDataFrame([(s, t * 250, 0) for s in (1, 2) for t in (10, 11, 40)], "session_id long, t_ms long, n int")
    batch = detections.tracks(df, stops, reach=70.0)
    stream = track_stream(feed(spark, df, str(tmp_path / "in")), feed(spark, stops, str(tmp_path / "stops")), [0, 1, 2], reach=70.0)
    columns = ["session_id", "code", "det_id", "track_id", "t_ms", "x", "y", "score"]
    same(run(stream, "track_stream").select(columns), batch.select(columns))


def test_timers_end_what_waits(spark, tmp_path):
    """What waits is over two seconds later although its session sends nothing more, and the session ends by its idle time."""
    machine = Machine(lambda state, row: ([row[0], row[1]], []), ("event_id", "t_ms"), "event_id long, what string",
                      finish=lambda state: [(state[0] if state else None, "ended")], deadline=lambda state: state[1] + 2_000 if state else None,
                      forget=lambda state, now: (None, [(state[0], "over")]))
    df = spark.createDataFrame([(1, 1_000, 11), (1, 2_500, 12), (2, 1_000, 21), (3, 30_000, 31)], "session_id long, t_ms long, event_id long")
    out = run(run_machine(feed(spark, df, str(tmp_path / "in")), machine, ["session_id"], ["event_id"], watermark="1 seconds", idle_ms=60_000), "timer_stream")
    rows = sorted((r.session_id, r.event_id, r.what) for r in out.filter("session_id > 0").collect() if r.event_id is not None)
    assert rows == [(1, 12, "over"), (2, 21, "over"), (3, 31, "over")]
    assert out.filter("session_id > 0 and what = 'ended'").count() == 3


def test_late_rows_are_counted_and_change_nothing(spark, tmp_path):
    df = samples(spark)
    late = df.filter("t_ms < 5000 and session_id = 1").withColumn("candidate", F.lit(9).cast("long"))
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        stream = LateRows.watch(feed(spark, df, str(tmp_path / "in"), late))
        out = run(run_machine(stream, COIN, ["session_id"], ["event_id"]), "late_stream")
        same(out, coin_counter(df, time_order(df)))
        for _ in range(50):
            if listener.arrived["late_stream"] >= df.count() + late.count() + 2 and listener.late["late_stream"]:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.late["late_stream"] == late.count() == 10
    assert listener.arrived["late_stream"] == df.count() + late.count() + 2


def test_bins(spark, tmp_path):
    df = samples(spark)
    folder = str(tmp_path / "in")
    write_parts(spark, df, folder)
    # one late row far ahead closes every earlier bin
    spark.createDataFrame([(9, 10_000_000, 1, False, False, None, 0.9)], df.schema).write.mode("append").parquet(folder)
    stream = with_event_time(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    counts = {"paused_samples": F.col("paused")}
    out = run(binned_counts(stream, counts), "bin_stream").filter("session_id < 9").select("session_id", "start_ms", "paused_samples")
    batch = count_by_bin(df, 5_000, counts).select("session_id", "start_ms", "paused_samples")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_gap_sessions_and_duplicates(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1), (1, 1_000, 2), (1, 1_000, 2), (1, 20_000, 3)], "session_id long, t_ms long, event_id long")
    folder = str(tmp_path / "in")
    df.coalesce(1).write.parquet(folder)
    spark.createDataFrame([(9, 10_000_000, 9)], df.schema).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: with_event_time(spark.readStream.schema(df.schema).parquet(folder))
    once = run(distinct_events(read(), ["event_id"]), "once").filter("session_id = 1")
    assert once.count() == 3
    sessions = run(gap_sessions(read(), "10 seconds", ["session_id"]), "gaps").filter("session_id = 1")
    assert sorted((r["start_ms"], r["last_ms"]) for r in sessions.collect()) == [(0, 1_000), (20_000, 20_000)]
