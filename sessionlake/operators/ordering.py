"""Time order inside a session, safe for sessions that are too large for one task.

Every window in this package runs over "the rows of one session in time order".  A plain
``Window.partitionBy(session)`` would put a session that holds a third of the table into one task.
:func:`time_order` therefore counts rows per session first.  When every session is small it hands back
plain windows.  When one is not, that session is cut into consecutive pieces (``_piece``) of bounded size and

* running aggregates are computed per piece plus a carry taken from one summary row per piece,
* row frames are computed per piece and again for the few rows next to a cut,

so the results equal those of the plain window while no task ever holds a whole large session.
The cut table has at most ``rows / limit`` entries, which is what makes broadcasting it safe.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.session import cut_lineage

GROUP_ROWS_CONF = "spark.sessionlake.maxGroupRows"
DEFAULT_GROUP_ROWS = 1_000_000
MAX_CUT_ROWS = 200_000
DEPTH = 4

_PIECE, _LARGE = "_piece", "_large"


def group_row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(GROUP_ROWS_CONF, str(DEFAULT_GROUP_ROWS)))


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` over the rows up to (or, with ``reverse``, from) the current one."""

    kind: str
    expr: Column
    exclusive: bool = False
    reverse: bool = False


def running_max(expr: Column, exclusive: bool = False) -> Running:
    return Running("max", expr, exclusive)


def running_min(expr: Column, exclusive: bool = False) -> Running:
    return Running("min", expr, exclusive)


def running_sum(expr: Column, exclusive: bool = False) -> Running:
    return Running("sum", expr, exclusive)


def last_seen(expr: Column, exclusive: bool = False) -> Running:
    """Latest non-null value so far."""
    return Running("last", expr, exclusive)


def next_seen(expr: Column, exclusive: bool = False) -> Running:
    """Earliest non-null value from here on."""
    return Running("last", expr, exclusive, reverse=True)


@dataclass
class TimeOrder:
    keys: tuple[str, ...]
    by: tuple[str, ...]
    cuts: list[DataFrame] = field(default_factory=list)

    @property
    def split(self) -> bool:
        return bool(self.cuts)

    # ---- piece tags -------------------------------------------------------------------------
    def tag(self, df: DataFrame) -> DataFrame:
        """Add the piece columns when the data has large sessions, else return the rows unchanged."""
        if not self.split:
            return df
        parts: list[str] = []
        for level, cut in enumerate(self.cuts):
            on = [*self.keys, *parts]
            df = df.join(F.broadcast(cut), on, "left")
            name = f"_p{level}"
            df = df.withColumn(name, F.coalesce(_cut_index(self.by), F.lit(0).cast("long")))
            if level == 0:
                df = df.withColumn(_LARGE, F.col("_width").isNotNull())
            df = df.drop("_lo", "_width", "_on_tie", "_at")
            parts.append(name)
        return df.withColumn(_PIECE, F.struct(*parts)).drop(*parts)

    def untag(self, df: DataFrame) -> DataFrame:
        return df.drop(_PIECE, _LARGE)

    @property
    def group(self) -> list[str]:
        return [*self.keys, _PIECE] if self.split else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(*self.by)

    def _session_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.by)

    # ---- windows ------------------------------------------------------------------------------
    def _apart(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of ordinary sessions, and rows of large ones with their lineage cut.

        Later steps read the large rows twice; without the cut every step would double the work of the ones before it.
        The constant flags let the optimizer drop the other half when the two are taken apart again.
        """
        small = df.filter(~F.col(_LARGE)).withColumn(_LARGE, F.lit(False))
        large = cut_lineage(df.filter(_LARGE)).withColumn(_LARGE, F.lit(True))
        return small, large

    def frames(self, df: DataFrame, reach: int, **cols: Callable[[WindowSpec], Column]) -> DataFrame:
        """Columns that look at most ``reach`` rows back or ahead; ``df`` must be tagged."""
        s = self._session_window()
        whole = lambda rows: rows.withColumns({name: make(s) for name, make in cols.items()})
        if not self.split:
            return whole(df)
        small, large = self._apart(df)
        w = self.window()
        local = large.withColumns({
            **{name: make(w) for name, make in cols.items()},
            "_from_start": F.row_number().over(w),
            "_to_end": F.count(F.lit(1)).over(Window.partitionBy(*self.group)) - F.row_number().over(w),
        })
        near = (F.col("_from_start") <= 2 * reach) | (F.col("_to_end") < 2 * reach)
        redo = (F.col("_from_start") <= reach) | (F.col("_to_end") < reach)
        edge = whole(local.filter(near)).filter(redo)
        pieces = local.filter(~redo).unionByName(edge).drop("_from_start", "_to_end")
        return whole(small).unionByName(pieces)

    def running(self, df: DataFrame, **specs: Running) -> DataFrame:
        """Running aggregates in time order; ``df`` must be tagged."""

        def frame(spec: Running, w: WindowSpec) -> WindowSpec:
            if spec.reverse:
                return w.rowsBetween(1 if spec.exclusive else 0, Window.unboundedFollowing)
            return w.rowsBetween(Window.unboundedPreceding, -1 if spec.exclusive else 0)

        def over(spec: Running, expr: Column, spec_window: WindowSpec) -> Column:
            if spec.kind == "last":
                pick = F.first if spec.reverse else F.last
                return pick(expr, ignorenulls=True).over(spec_window)
            return getattr(F, spec.kind)(expr).over(spec_window)

        def along(rows: DataFrame, w: WindowSpec) -> DataFrame:
            return rows.withColumns({name: over(spec, spec.expr, frame(spec, w)) for name, spec in specs.items()})

        if not self.split:
            return along(df, self._session_window())
        small, large = self._apart(df)
        position = F.struct(*self.by)

        def piece_value(spec: Running) -> Column:
            if spec.kind == "last":
                pick = F.min_by if spec.reverse else F.max_by
                return pick(spec.expr, F.when(spec.expr.isNotNull(), position))
            return getattr(F, spec.kind)(spec.expr)

        summary = large.groupBy(*self.keys, _PIECE).agg(*[piece_value(spec).alias(f"_{name}") for name, spec in specs.items()])
        pieces = Window.partitionBy(*self.keys).orderBy(_PIECE)
        before = pieces.rowsBetween(Window.unboundedPreceding, -1)
        after = pieces.rowsBetween(1, Window.unboundedFollowing)
        carry = summary.select(
            *self.keys, _PIECE,
            *[over(spec, F.col(f"_{name}"), after if spec.reverse else before).alias(f"_{name}")
              for name, spec in specs.items()])
        joined = along(large, self.window()).join(F.broadcast(carry), [*self.keys, _PIECE], "left")

        def merged(name: str, spec: Running) -> Column:
            here, earlier = F.col(name), F.col(f"_{name}")
            if spec.kind == "last":
                return F.coalesce(here, earlier)
            if spec.kind == "sum":
                return F.coalesce(here + earlier, here, earlier)
            return (F.greatest if spec.kind == "max" else F.least)(here, earlier)

        done = joined.withColumns({name: merged(name, spec) for name, spec in specs.items()}).drop(*[f"_{name}" for name in specs])
        return along(small, self._session_window()).unionByName(done)


def _cut_index(by: tuple[str, ...]) -> Column:
    """Position of a row among the pieces of its level; a cut on the tie-breaker applies to one instant only."""
    return F.expr(
        f"CASE WHEN NOT _on_tie THEN (`{by[0]}` - _lo) div _width WHEN `{by[0]}` < _at THEN -1L "
        f"WHEN `{by[0]}` > _at THEN {1 << 60}L ELSE (`{by[1]}` - _lo) div _width END")


def time_order(df: DataFrame, keys: str | Sequence[str] = "session_id",
               by: Sequence[str] = ("t_ms", "event_id"), limit: int | None = None) -> TimeOrder:
    """Count rows per session and decide where large sessions are cut.

    Sessions are always counted: sizes that the optimizer estimates say nothing about rows made by a generator or packed well.

    ``by[0]`` and ``by[1]`` must be integral; the second is used to cut an instant that alone holds too many rows.
    The probe reads only the key and order columns.
    """
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    by = tuple(by)
    limit = limit or group_row_limit(df)
    return _probe(df.select(*keys, *dict.fromkeys(by[:2])), keys, by, limit)


def _probe(slim: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], limit: int) -> TimeOrder:
    order = TimeOrder(keys, by)
    spark = slim.sparkSession
    first, tie = F.col(by[0]), F.col(by[1])
    parts: list[str] = []
    rows = slim
    for level in range(DEPTH):
        stats = rows.groupBy(*keys, *parts).agg(
            F.count(F.lit(1)).alias("_n"), F.min(first).alias("_lo"), F.max(first).alias("_hi"),
            F.min(tie).alias("_tie_lo"), F.max(tie).alias("_tie_hi"))
        floor = limit if level == 0 else 2 * limit
        found = stats.filter(F.col("_n") > floor).limit(MAX_CUT_ROWS + 1).collect()
        while len(found) > MAX_CUT_ROWS:
            floor, limit = floor * 8, limit * 8
            found = stats.filter(F.col("_n") > floor).limit(MAX_CUT_ROWS + 1).collect()
        if level == 0 and found:
            # pieces are broadcast and, in folds, listed on the driver: keep their number bounded
            limit = max(limit, -(-sum(row["_n"] for row in found) // MAX_CUT_ROWS))
            found = [row for row in found if row["_n"] > limit]
        table = []
        for row in found:
            on_tie = row["_hi"] == row["_lo"]
            lo, hi = (row["_tie_lo"], row["_tie_hi"]) if on_tie else (row["_lo"], row["_hi"])
            if hi == lo:
                continue
            width = max(1, -(-((int(hi) - int(lo) + 1) * limit) // row["_n"]))
            table.append((*[row[name] for name in (*keys, *parts)], int(lo), width, on_tie, int(row["_lo"])))
        if not table:
            break
        names = [*keys, *parts]
        schema = T.StructType([slim.schema[name] if name in keys else T.StructField(name, T.LongType()) for name in names]
                              + [T.StructField("_lo", T.LongType()), T.StructField("_width", T.LongType()),
                                 T.StructField("_on_tie", T.BooleanType()), T.StructField("_at", T.LongType())])
        cut = spark.createDataFrame(table, schema)
        order.cuts.append(cut)
        name = f"_p{level}"
        rows = rows.join(F.broadcast(cut), names).withColumn(name, _cut_index(by)).drop("_lo", "_width", "_on_tie", "_at")
        parts.append(name)
    return order


def island_ids(df: DataFrame, order: TimeOrder, starts: Column, name: str = "island") -> DataFrame:
    """Number consecutive groups: every row where ``starts`` holds opens the next one."""
    return order.running(df, **{name: running_sum(F.when(starts, 1).otherwise(0).cast("long"))})
