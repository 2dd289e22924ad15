"""Half-open time bins, boundary snapshots, bin deltas and moving means.

Rows are aggregated into bins first (partial aggregation before the shuffle); the windows that follow run over
bins, of which a session has only duration / bin width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.operators.ordering import TimeOrder, running_sum, time_order


def bin_start(time: Column, bin_ms: int) -> Column:
    return (F.floor(time / bin_ms) * bin_ms).cast("long")


def bin_spine(sessions: DataFrame, duration_ms: int | Column, bin_ms: int, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Every bin of every session, the last one cut at the duration."""
    end = duration_ms if isinstance(duration_ms, Column) else F.lit(duration_ms)
    return (
        sessions.withColumn("_end", end.cast("long"))
        .select(*keys, "_end", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_end") - 1, F.lit(bin_ms).cast("long"))).alias("start_ms"))
        .select(*keys, "start_ms", F.least(F.col("start_ms") + bin_ms, F.col("_end")).alias("end_ms"))
    )


def observed_durations(rows: DataFrame, bin_ms: int, *, time: str = "t_ms", keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """``duration_ms`` of each session without a recorded length: the end of the bin that holds its last row."""
    return rows.groupBy(*keys).agg((bin_start(F.max(time), bin_ms) + bin_ms).alias("duration_ms"))


def count_by_bin(events: DataFrame, bin_ms: int, counts: dict[str, Column], *, time: str = "t_ms",
                 keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Conditional counts per half-open bin of the anchor time."""
    return events.groupBy(*keys, bin_start(F.col(time), bin_ms).alias("start_ms")).agg(
        *[F.count_if(condition).alias(name) for name, condition in counts.items()])


def boundary_windows(samples: DataFrame, duration_ms: int | None, bin_ms: int, *, value: str, time: str = "t_ms",
                     tie: str = "event_id", key: str = "session_id") -> DataFrame:
    """Counter at both boundaries of each bin and its increase; NULL where the bin saw no sample.

    A boundary takes the last sample at or before it, so samples are grouped into bins closed on the right and
    the snapshots are a running last over those bins.  A bin counts as observed when a sample lies in the
    *closed* interval between its boundaries.  Without a duration each session ends with the bin of its last sample.
    """
    right_bin = (F.ceil(F.col(time) / bin_ms) - 1).cast("long")
    last = samples.groupBy(key, right_bin.alias("_b")).agg(
        F.max(F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), F.col(value).alias("v"))).alias("_s"))
    if duration_ms is None:
        ends = observed_durations(samples, bin_ms, time=time, keys=(key,)).select(key, F.expr(f"duration_ms div {bin_ms}").alias("_n"))
    else:
        ends = samples.select(key).distinct().withColumn("_n", F.lit(-(-duration_ms // bin_ms)).cast("long"))
    spine = ends.select(key, F.explode(F.sequence(F.lit(-1).cast("long"), F.col("_n") - 1)).alias("_b"))
    w = Window.partitionBy(key).orderBy("_b")
    snap = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = spine.join(last, [key, "_b"], "left").withColumn("_at_end", snap)
    rows = rows.withColumn("_at_start", F.lag("_at_end").over(w)).filter("_b >= 0")
    start = F.col("_b") * bin_ms
    seen = F.col("_s").isNotNull() | (F.col("_at_start.t") == start)
    usable = F.col("_at_start").isNotNull() & seen
    return rows.select(
        key, start.alias("start_ms"), (start + bin_ms if duration_ms is None else F.least(start + bin_ms, F.lit(duration_ms).cast("long"))).alias("end_ms"),
        F.coalesce("_at_start.v", F.lit(0)).cast("long").alias("counter_start"),
        F.when(F.col("_at_start").isNotNull(), F.col("_at_end.v")).otherwise(0).cast("long").alias("counter_end"),
        F.when(usable, F.greatest(F.lit(0), F.col("_at_end.v") - F.col("_at_start.v"))).cast("long").alias("delta"),
        usable.alias("observed"))


def last_value_bins(points: DataFrame, bin_ms: int, *, value: str, time: str = "t_ms", tie: str = "event_id",
                    key: str = "session_id") -> DataFrame:
    """Latest reading of each half-open bin."""
    return points.groupBy(key, bin_start(F.col(time), bin_ms).alias("start_ms")).agg(
        F.max(F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), F.col(value).alias("v"))).alias("_s")
    ).select(key, "start_ms", F.col("_s.t").alias("observed_at_ms"), F.col("_s.v").alias("value"))


def bin_deltas(bins: DataFrame, bin_ms: int, key: str = "session_id") -> DataFrame:
    """Increase between adjacent bins; gaps and decreases yield no row."""
    w = Window.partitionBy(key).orderBy("start_ms")
    return (
        bins.withColumns({"_prev_start": F.lag("start_ms").over(w), "counter_start": F.lag("value").over(w)})
        .filter((F.col("start_ms") == F.col("_prev_start") + bin_ms) & (F.col("value") >= F.col("counter_start")))
        .withColumn("delta", F.col("value") - F.col("counter_start")).drop("_prev_start")
    )


def segment_means(bins: DataFrame, *, bin_ms: int, gap_ms: int = 10_000, half_ms: int = 15_000,
                  key: str = "session_id") -> DataFrame:
    """Centred mean over the bins of a segment; a gap above ``gap_ms`` starts a new segment."""
    w = Window.partitionBy(key).orderBy("start_ms")
    previous = F.lag("start_ms").over(w)
    rows = bins.withColumn("break_before", previous.isNull() | (F.col("start_ms") - previous > gap_ms))
    rows = rows.withColumn("segment_index", F.sum(F.col("break_before").cast("long")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    near = Window.partitionBy(key, "segment_index").orderBy("start_ms").rangeBetween(-half_ms, half_ms)
    return rows.select(key, (F.col("start_ms") + bin_ms // 2).alias("center_ms"), F.avg("value").over(near).alias("value"),
                       "break_before", "segment_index")


def centered_mean(points: DataFrame, order: TimeOrder, *, value: str, half_ms: int = 15_000, name: str = "mean") -> DataFrame:
    """Mean of all readings within ``half_ms`` of each reading.

    Sessions of ordinary size use one range frame.  When a session is too large, readings are first reduced to one
    row per instant and cut into time tiles; each instant also goes to the neighbouring tiles it can reach.
    """
    time = order.by[0]
    if not order.split:
        near = Window.partitionBy(*order.keys).orderBy(time).rangeBetween(-half_ms, half_ms)
        return points.withColumn(name, F.avg(value).over(near))
    instants = points.groupBy(*order.keys, time).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    tile_ms = 4 * half_ms
    tiles = F.array_distinct(F.transform(
        F.array(F.col(time) - half_ms, F.col(time), F.col(time) + half_ms), lambda t: F.floor(t / tile_ms).cast("long")))
    spread = instants.withColumn("_tile", F.explode(tiles))
    near = Window.partitionBy(*order.keys, "_tile").orderBy(time).rangeBetween(-half_ms, half_ms)
    means = (
        spread.withColumn(name, F.sum("_s").over(near) / F.sum("_n").over(near))
        .filter(F.col("_tile") == F.floor(F.col(time) / tile_ms)).select(*order.keys, time, name)
    )
    return points.join(means, [*order.keys, time], "left")


def endpoint_bins(samples: DataFrame, bin_s: int, *, second: str, value: str, tie: str, key: str = "session_id") -> DataFrame:
    """Value at each bin end, or the last one before it, up to the bin that covers the last second."""
    right_bin = (F.ceil(F.col(second) / bin_s) - 1).cast("long")
    last = samples.groupBy(key, F.greatest(right_bin, F.lit(0)).alias("_b")).agg(
        F.max(F.struct(F.col(second).alias("s"), F.col(tie).alias("i"), F.col(value).alias("v"))).alias("_s"))
    spine = samples.groupBy(key).agg(F.max(second).alias("_max")).select(
        key, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("_max") + 1) / bin_s).cast("long") - 1)).alias("_b"))
    w = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spine.join(last, [key, "_b"], "left").withColumn("_s", F.last("_s", ignorenulls=True).over(w))
        .filter(F.col("_s").isNotNull())
        .select(key, (F.col("_b") * bin_s).alias("start_s"), ((F.col("_b") + 1) * bin_s).alias("end_s"),
                F.col("_s.s").alias("matched_s"), F.col("_s.v").alias("value"))
    )


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float],
                    scale: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles per group of readings that carry at most ``log10(scale)`` decimals.

    Equal readings are counted first, then ranks are running sums over the distinct readings in order, so a
    group may be arbitrarily large.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(
        *keys, F.round(F.col(value) * scale).cast("long").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    order = time_order(counted, keys, ("_v", "_v"))
    ranked = order.untag(order.running(order.tag(counted), _upto=running_sum(F.col("_n"))))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    rows = ranked.join(totals, list(keys))
    aggs = []
    for name, p in probabilities.items():
        position = (F.col("_total") - 1) * F.lit(p)
        low, high = F.floor(position), F.ceil(position)
        holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
        low_v, high_v = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(high), F.col("_v")))
        share = F.max(position - low)
        aggs.append(((low_v + (high_v - low_v) * share) / scale).alias(name))
    return rows.groupBy(*keys).agg(*aggs)

