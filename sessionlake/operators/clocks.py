"""Validation of on-screen clocks and segmentation of a recording into runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.scalars import clock_seconds
from sessionlake.operators.ordering import TimeOrder, island_ids, last_seen, next_seen, running_max, running_sum, time_order


def clock_quality(rows: DataFrame, order: TimeOrder, text: str, duration_ms: int, *, max_rate: float = 2.1,
                  jump_review_s: int = 3) -> DataFrame:
    """Status and reasons of every clock reading; rejected readings are never replaced.

    Rejected values lie below the last accepted one, so the last accepted value is the running maximum of the
    readings that passed the bound and the isolated dip/spike rules.
    """
    bound = int(duration_ms / 1000 * max_rate) + 2
    d = order.tag(rows.withColumn("_clock", clock_seconds(F.col(text))))
    d = d.withColumns({"parsed_s": F.col("_clock.seconds"), "_why": F.col("_clock.reason")}).drop("_clock")
    v = F.col("parsed_s")
    d = order.running(d, _before=last_seen(v, exclusive=True), _after=next_seen(v, exclusive=True),
                      _index=running_sum(F.lit(1).cast("long")))
    returns = F.col("_after") >= F.col("_before")
    isolated = F.coalesce(returns & ((v < F.col("_before")) | (v > F.col("_after"))), F.lit(False))
    beyond = F.coalesce(v > bound, F.lit(False))
    d = d.withColumns({"_beyond": beyond, "_isolated": isolated})
    passed = v.isNotNull() & ~F.col("_beyond") & ~F.col("_isolated")
    d = order.running(d.withColumn("_passed", passed), _floor=running_max(F.when(F.col("_passed"), v), exclusive=True))
    d = d.withColumn("_backward", F.coalesce(F.col("_passed") & (v < F.col("_floor")), F.lit(False)))
    d = d.withColumn("accepted_s", F.when(F.col("_passed") & ~F.col("_backward"), v))
    ok = F.when(F.col("accepted_s").isNotNull(), F.struct("_index", "accepted_s"))
    d = order.running(d.withColumn("_ok", ok), _last_ok=last_seen(F.col("_ok"), exclusive=True))
    jumped = F.coalesce(
        F.col("accepted_s") - F.col("_last_ok.accepted_s")
        > jump_review_s * F.greatest(F.lit(1), F.col("_index") - F.col("_last_ok._index")), F.lit(False))
    rejections = F.concat_ws(
        "|", F.when(F.col("_isolated"), "isolated_order_violation"), F.when(F.col("_backward"), "monotonicity_violation"),
        F.when(F.col("_beyond"), "outside_video_clock_bound"))
    status = (F.when(F.col("_why") == "missing_ocr", "missing").when(F.col("_why").isNotNull(), "rejected")
              .when(F.col("accepted_s").isNull(), "rejected").when(jumped, "review").otherwise("accepted"))
    reasons = (F.when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("accepted_s").isNull(), rejections)
               .when(jumped, "large_positive_clock_discontinuity").otherwise(""))
    d = d.withColumns({"status": status, "reasons": reasons})
    return order.untag(d).select(*rows.columns, "parsed_s", "accepted_s", "status", "reasons")


def normalised_timer(text: Column, allow_embedded: bool) -> Column:
    """Struct ``(value, policy)``: an exact ``mm:ss``, or the only embedded one."""
    cleaned = F.regexp_replace(text, "[^0-9:]", "")
    valid = lambda s: s.rlike("^[0-9]{2}:[0-9]{2}$") & (F.substring(s, 4, 2).try_cast("int") < 60)
    places = F.sequence(F.lit(1), F.greatest(F.length(cleaned) - 4, F.lit(1)))
    embedded = F.filter(F.transform(places, lambda i: F.substring(cleaned, i, F.lit(5))), valid)
    policy = F.when(text.isNull(), "missing_text").when(valid(cleaned), "exact_cleaned_mm_ss")
    value = F.when(valid(cleaned), cleaned)
    if allow_embedded:
        policy = policy.when(F.size(embedded) == 1, "unique_embedded_mm_ss").when(F.size(embedded) > 1, "ambiguous_embedded_mm_ss")
        value = value.when(F.size(embedded) == 1, F.get(embedded, F.lit(0)))
    return F.struct(value.alias("value"), policy.otherwise("no_valid_mm_ss").alias("policy"))


def best_candidate(candidates: DataFrame, keys: list[str], value: str, confidence: str, position: str,
                   min_confidence: float = 0.0) -> DataFrame:
    """Most confident valid candidate per key; the earliest one wins a tie."""
    usable = F.col(value).isNotNull() & (F.col(confidence) >= min_confidence)
    rank = F.when(usable, F.struct(F.col(confidence).alias("c"), (-F.col(position)).alias("p"), F.col(value).alias("v")))
    return candidates.groupBy(*keys).agg(F.max(rank).alias("_m"), F.count_if(usable).alias("valid_candidates")).select(
        *keys, F.col("_m").isNotNull().alias("observed"), F.col("_m.v").alias("value"), F.col("_m.c").alias("confidence"),
        "valid_candidates")


def gameplay_runs(rows: DataFrame, order: TimeOrder, *, second: str, clock: str, reset_s: int = 10, gap_s: int = 5) -> DataFrame:
    """Runs of play: a clock at 0 or 1 after the start, after a jump back, or after unreadable seconds opens one."""
    observed = order.tag(rows.filter(F.col(clock).isNotNull()))
    d = order.frames(observed, 1, _s=lambda w: F.lag(second).over(w), _c=lambda w: F.lag(clock).over(w))
    low = F.col(clock) <= 1
    d = order.running(d, _seen=running_sum(F.when(low, 1).otherwise(0).cast("long"), exclusive=True))
    reset = F.coalesce(F.col(clock) + reset_s < F.col("_c"), F.lit(False))
    after_gap = F.col("_s").isNull() | (F.col(second) - F.col("_s") >= gap_s)
    opens = low & ((F.coalesce("_seen", F.lit(0)) == 0) | reset | after_gap)
    d = order.untag(island_ids(d, order, opens, "run_index")).filter(F.col("run_index") > 0)
    return d.groupBy(*order.keys, "run_index").agg(
        (F.min(second) * 1000).alias("start_ms"), ((F.max(second) + 1) * 1000).alias("end_ms")
    ).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def first_sustained(qualifying: DataFrame, *, second: str = "second", key: str = "session_id", length: int = 2) -> DataFrame:
    """First second of the first stretch of at least ``length`` consecutive qualifying seconds."""
    order = time_order(qualifying, key, (second, second))
    d = order.running(order.tag(qualifying), _n=running_sum(F.lit(1).cast("long")))
    stretches = order.untag(d).groupBy(key, (F.col(second) - F.col("_n")).alias("_island")).agg(
        F.min(second).alias("onset_second"), F.count(F.lit(1)).alias("_len"))
    return stretches.filter(F.col("_len") >= length).groupBy(key).agg(F.min("onset_second").alias("onset_second"))


def ledger_quality(ledger: DataFrame, *, key: str = "session_id", second: str = "second", min_timer_rate: float = 0.0,
                   min_counter_rate: float = 0.0) -> DataFrame:
    """One quality report per session over its per-second ledger.

    Ledger columns: ``timer_observed, counter_observed, counter_state, state_source, excluded``.  Blank seconds
    before the first positive state do not count against the counter rate.
    """
    order = time_order(ledger, key, (second, second))
    d = order.tag(ledger)
    eligible = ~F.col("excluded")
    d = order.frames(d, 1, _prev_second=lambda w: F.lag(second).over(w))
    d = order.running(
        d, _positive=running_max(F.when(eligible & (F.col("counter_state") > 0), 1).otherwise(0)),
        _last_state=last_seen(F.col("counter_state"), exclusive=True))
    blank_zero = (eligible & (F.col("_positive") == 0) & ~F.col("counter_observed") & (F.col("counter_state") == 0)
                  & F.col("state_source").isin("carried_forward", "assumed_initial_state"))
    sums = order.untag(d).groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(eligible).alias("eligible_seconds"),
        F.count_if(eligible & F.col("timer_observed")).alias("timer_observed_count"),
        F.count_if(eligible & F.col("counter_observed")).alias("counter_observed_count"),
        F.count_if(blank_zero).alias("blank_zero_seconds"),
        F.count_if(F.col("state_source") == "carried_forward").alias("carried_count"),
        F.count_if(F.coalesce(F.col(second) - F.col("_prev_second"), F.lit(1)) != 1).alias("_gaps"),
        F.count_if(F.col("counter_state") < F.col("_last_state")).alias("_drops"))
    rate = lambda part, whole: F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), 8)
    sums = sums.withColumns({
        "timer_rate": rate(F.col("timer_observed_count"), F.col("eligible_seconds")),
        "counter_rate": rate(F.col("counter_observed_count"), F.col("eligible_seconds") - F.col("blank_zero_seconds"))})
    failed = F.concat_ws(
        "|", F.when(F.col("_drops") > 0, "counter_state_is_monotonic"),
        F.when(F.col("counter_rate") < min_counter_rate, "counter_observed_rate_meets_threshold"),
        F.when(F.col("_gaps") > 0, "seconds_are_contiguous"),
        F.when(F.col("timer_rate") < min_timer_rate, "timer_observed_rate_meets_threshold"))
    warn = (F.col("timer_rate") < 0.5) | (F.col("counter_rate") < 0.5)
    return sums.withColumn("failed_checks", failed).withColumn(
        "status", F.when(F.col("failed_checks") != "", "failed").when(warn, "warning").otherwise("passed")).drop("_gaps", "_drops")
