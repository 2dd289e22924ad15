"""Left folds whose state feeds back into acceptance, run per session without holding a session in memory.

Rows are shuffled by session and sorted, and each partition streams through ``mapInArrow`` with one small
state per session.  Sessions above the row limit are cut into pieces that run in parallel: every piece starts
from a guessed state, pieces whose true incoming state differs are run again, until all guesses agree.  The
result is exactly the sequential one; acceptance machines forget their start quickly, so few rounds are needed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sessionlake.operators.ordering import _LARGE, _PIECE, TimeOrder
from sessionlake.session import cut_lineage

Step = Callable[[Any, tuple], tuple[Any, Iterable[tuple]]]
Finish = Callable[[Any], Iterable[tuple]]


def _walker(keys: Sequence[str], columns: Sequence[str], step: Step, finish: Finish | None, initial: Any,
            schema: T.StructType, states_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over a sorted partition; ``_start`` carries the incoming state of a piece as JSON."""
    width = len(keys)

    def close(group: tuple, state: Any, last: bool) -> Iterable[tuple]:
        if states_only:
            return [(*group, json.dumps(state))]
        if finish is not None and last:
            return [(*group[:width], *row) for row in finish(state)]
        return []

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(values), type=kind.type) for values, kind in zip(zip(*rows), arrow)], schema=arrow)

        group, state, last = None, None, True
        for batch in batches:
            out: list[tuple] = []
            values = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            groups = zip(*[values[name] for name in keys], values["_group"])
            bodies = zip(*[values[name] for name in columns])
            for here, start, is_last, body in zip(groups, values["_start"], values["_last"], bodies):
                if here != group:
                    if group is not None:
                        out.extend(close(group, state, last))
                    group, last = here, is_last
                    state = initial() if start is None else json.loads(start)
                state, rows = step(state, body)
                if not states_only:
                    out.extend((*group[:width], *row) for row in rows)
            if out:
                yield pack(out)
        if group is not None:
            tail = list(close(group, state, last))
            if tail:
                yield pack(tail)

    return walk


def session_fold(df: DataFrame, order: TimeOrder, columns: Sequence[str], step: Step, out_fields: str,
                 initial: Callable[[], Any] = lambda: None, finish: Finish | None = None) -> DataFrame:
    """Fold ``step(state, row) -> (state, output rows)`` over every session in time order.

    ``columns`` are the row fields handed to ``step``; ``out_fields`` is the DDL of the emitted rows (the session
    keys are put in front).  States must survive JSON.
    """
    keys = list(order.keys)
    key_fields = [df.schema[name] for name in keys]
    out_schema = T.StructType(key_fields + T._parse_datatype_string(out_fields).fields)
    fields = list(dict.fromkeys([*keys, *order.by, *columns]))
    tagged = order.tag(df.select(*fields))
    piece = F.to_json(_PIECE) if order.split else F.lit("")
    tagged = tagged.withColumn("_group", piece)

    def run(rows: DataFrame, states_only: bool, schema: T.StructType) -> DataFrame:
        sort = [*keys, *([_PIECE] if order.split else []), *order.by]
        ready = rows.repartition(*keys, "_group").sortWithinPartitions(*sort)
        slim = ready.select(*keys, "_group", "_start", "_last",
                            *[F.col(name).alias(f"_c{i}") for i, name in enumerate(columns)])
        walk = _walker(keys, [f"_c{i}" for i in range(len(columns))], step, finish, initial, schema, states_only)
        return slim.mapInArrow(walk, schema)

    if not order.split:
        ready = tagged.withColumns({"_start": F.lit(None).cast("string"), "_last": F.lit(True)})
        return run(ready, False, out_schema)

    state_schema = T.StructType([*key_fields, T.StructField("_group", T.StringType()), T.StructField("_state", T.StringType())])
    large = cut_lineage(tagged.filter(_LARGE))
    chain: dict[tuple, list[str]] = {}
    for row in large.select(*keys, _PIECE, "_group").distinct().orderBy(*keys, _PIECE).collect():
        chain.setdefault(tuple(row[name] for name in keys), []).append(row["_group"])
    starts = {(key, group): json.dumps(initial()) for key, groups in chain.items() for group in groups}
    ends: dict[tuple, str] = {}
    stale = set(starts)
    spark = df.sparkSession
    start_schema = T.StructType([*key_fields, T.StructField("_group", T.StringType()),
                                 T.StructField("_start", T.StringType()), T.StructField("_last", T.BooleanType())])

    def start_table(wanted: Iterable[tuple]) -> DataFrame:
        rows = [(*key, group, starts[(key, group)], chain[key][-1] == group) for key, group in wanted]
        return F.broadcast(spark.createDataFrame(rows, start_schema))

    while stale:
        again = large.join(start_table(stale), [*keys, "_group"])
        for row in run(again, True, state_schema).collect():
            ends[(tuple(row[name] for name in keys), row["_group"])] = row["_state"]
        stale = set()
        for key, groups in chain.items():
            for before, after in zip(groups, groups[1:]):
                if starts[(key, after)] != ends[(key, before)]:
                    starts[(key, after)] = ends[(key, before)]
                    stale.add((key, after))
    rest = tagged.filter(~F.col(_LARGE)).withColumns({"_start": F.lit(None).cast("string"), "_last": F.lit(True)})
    whole = rest.unionByName(large.join(start_table(starts), [*keys, "_group"]).select(rest.columns))
    return run(whole, False, out_schema)


