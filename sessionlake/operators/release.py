"""Publication: canonical events, duplicate clusters, releases with coverage, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.operators.folds import session_fold
from sessionlake.operators.ordering import TimeOrder, island_ids, time_order
from sessionlake.operators.timejoin import asof

# fixed values: evidence grades from strong to weak
GRADE_RANK = {"A": 0, "B": 1, "C": 2, "D": 3}


def grade_rank(grade: Column) -> Column:
    rank = F.lit(99)
    for name, value in GRADE_RANK.items():
        rank = F.when(grade == name, value).otherwise(rank)
    return rank


def duplicate_clusters(events: DataFrame, *, item: str, gap_ms: int = 10_000, key: str = "session_id", time: str = "t_ms",
                       tie: str = "event_id") -> DataFrame:
    """Number the clusters of events of one item that follow each other within the gap."""
    order = time_order(events, (key, item), (time, tie))
    d = order.frames(order.tag(events), 1, _p=lambda w: F.lag(time).over(w))
    return order.untag(island_ids(d, order, F.col("_p").isNull() | (F.col(time) - F.col("_p") > gap_ms), "cluster")).drop("_p")


def canonical_clusters(clustered: DataFrame, *, item: str, from_chest: str, key: str = "session_id", time: str = "t_ms",
                       tie: str = "event_id") -> DataFrame:
    """One event per cluster: chest evidence first, then the earliest; best grade, accepted if any member is."""
    primary = F.min_by(F.struct(F.col(tie).alias("id"), F.col(time).alias("t")), F.struct(~F.col(from_chest), F.col(time), F.col(tie)))
    d = clustered.groupBy(key, item, "cluster").agg(
        primary.alias("_p"), F.min_by("evidence_grade", grade_rank(F.col("evidence_grade"))).alias("evidence_grade"),
        F.bool_or(F.col("publication_status") == "auto_accepted").alias("_ok"), F.count(F.lit(1)).alias("evidence_count"))
    return d.select(key, item, F.col("_p.id").alias(tie), F.col("_p.t").alias(time), "evidence_grade",
                    F.when(F.col("_ok"), "auto_accepted").otherwise("needs_review").alias("publication_status"), "evidence_count",
                    (F.col("evidence_count") > 1).alias("canonicalized"))


def match_to_transactions(lucky: DataFrame, transactions: DataFrame, *, tolerance_ms: int = 50, key: str = "session_id") -> DataFrame:
    """Closest transaction that overlaps a detection or whose anchor is within the tolerance.

    Transactions end at their anchor and do not nest, so the closest one is the last before or the first after.
    Both sides: ``start_ms, end_ms, anchor_ms, event_id``.
    """
    single = transactions.groupBy(key, "anchor_ms").agg(F.min_by(F.struct("event_id", "start_ms", "end_ms"), "event_id").alias("_t")).select(
        key, "anchor_ms", "_t.*")
    fields = ["event_id", "start_ms", "end_ms", "anchor_ms"]
    common = dict(keys=[key], left_time="anchor_ms", right_time="anchor_ms")
    d = asof(lucky, single, fields, prefix="b_", **common)
    d = asof(d, single, fields, prefix="f_", forward=True, **common)

    def gap(p: str) -> Column:
        distance = F.abs(F.col(f"{p}_anchor_ms") - F.col("anchor_ms"))
        overlap = (F.col("start_ms") <= F.col(f"{p}_end_ms")) & (F.col("end_ms") >= F.col(f"{p}_start_ms"))
        return F.when((distance <= tolerance_ms) | overlap, distance)

    d = d.withColumns({"_b": gap("b"), "_f": gap("f")})
    use_back = F.col("_b").isNotNull() & (F.col("_f").isNull() | (F.col("_b") <= F.col("_f")))
    pick = lambda name: F.when(use_back, F.col(f"b_{name}")).when(F.col("_f").isNotNull(), F.col(f"f_{name}"))
    return d.select(*lucky.columns, pick("event_id").alias("transaction_id"), pick("anchor_ms").alias("transaction_ms"))


def lucky_support(matched: DataFrame, *, fragment_gap_ms: int = 500, key: str = "session_id") -> DataFrame:
    """Transaction each detection supports: its own, or for a short following fragment the one published last.

    Detections without a transaction are dropped unless they continue the last published one, whose end keeps
    growing, so this is a fold; its state is that one event.
    """
    firsts = matched.filter("transaction_id IS NOT NULL").groupBy(key, "transaction_id").agg(
        F.min(F.struct("start_ms", "event_id")).alias("_first"))
    d = matched.join(firsts, [key, "transaction_id"], "left")
    d = d.withColumn("_opens", F.coalesce(F.col("_first") == F.struct("start_ms", "event_id"), F.lit(False))).drop("_first")
    order = time_order(d, key, ("start_ms", "event_id"))

    def step(last, row):
        ident, start, end, transaction, anchor, opens = row
        if transaction is not None:
            if opens:
                last = [transaction, max(end, anchor), anchor]
            elif last and last[0] == transaction:
                last = [transaction, max(last[1], end), last[2]]
            return last, [(ident, start, max(end, anchor) if opens else end, transaction, anchor, opens)]
        if last and 0 <= start - last[1] <= fragment_gap_ms:
            return [last[0], max(last[1], end), last[2]], [(ident, start, end, last[0], last[2], False)]
        return last, []

    return session_fold(d, order, ["event_id", "start_ms", "end_ms", "transaction_id", "transaction_ms", "_opens"], step,
                        "event_id long, start_ms long, end_ms long, transaction_id long, transaction_ms long, opens boolean")


def canonical_lucky(support: DataFrame, key: str = "session_id") -> DataFrame:
    base = F.max(F.when(F.col("opens"), F.struct("event_id", "start_ms")))
    return support.groupBy(key, "transaction_id", F.col("transaction_ms").alias("anchor_ms")).agg(
        base.alias("_b"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("evidence_count")
    ).select(key, F.col("_b.event_id").alias("event_id"), "transaction_id", F.col("_b.start_ms").alias("start_ms"), "end_ms", "anchor_ms", "evidence_count")


def last_wins(events: DataFrame, keys: Sequence[str], precedence: Sequence[str]) -> DataFrame:
    """Keep the last occurrence of each identifier."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*events.columns), F.struct(*precedence)).alias("_r")).select("_r.*")


def release_summary(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    accepted = F.count_if(F.col("publication_status") == "auto_accepted")
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), accepted.alias("accepted_count"),
                                     (F.count(F.lit(1)) - accepted).alias("review_count"))


def audit(facts: DataFrame, **checks: Column) -> DataFrame:
    """Names of the failed checks over one row of facts per run, and the resulting status."""
    failed = F.concat_ws("|", *[F.when(~F.coalesce(check, F.lit(False)), name) for name, check in sorted(checks.items())])
    return facts.withColumn("errors", failed).withColumn("status", F.when(F.col("errors") == "", "passed").otherwise("failed"))


def renumbered(rows: DataFrame, order: TimeOrder, prefix: str, name: str) -> DataFrame:
    """Sequential identifiers in time order within each session."""
    from sessionlake.operators.ordering import running_sum

    d = order.untag(order.running(order.tag(rows), _n=running_sum(F.lit(1).cast("long"))))
    return d.withColumn(name, F.format_string(prefix + "_%04d", "_n")).drop("_n")
