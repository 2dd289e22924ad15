"""Run a query on Spark and its SQL on DuckDB over the same tables and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.10g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(item) for item in value)
    return value


def canonical(columns, rows):
    pick = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(row[i]) for i in pick) for row in rows), key=repr)


def difference(spark, run, sql: str, folder: str) -> str | None:
    frame = run(spark, folder)
    left = canonical(frame.columns, [tuple(row) for row in frame.collect()])
    con = duck(folder)
    relation = con.sql(sql)
    right = canonical(list(relation.columns), relation.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        kinds = {type(a) != type(b) for x, y in zip(left[1], right[1]) for a, b in zip(x, y)}
        return "types differ" if True in kinds else None
    only_left = sorted(set(left[1]) - set(right[1]), key=repr)[:3]
    only_right = sorted(set(right[1]) - set(left[1]), key=repr)[:3]
    return f"{len(left[1])} rows vs {len(right[1])}; columns {left[0]}; spark {only_left}; sql {only_right}"


def main(names: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from sessionlake.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    limit = os.environ.get("GROUP_ROWS")
    if limit:
        spark.conf.set("spark.sessionlake.maxGroupRows", limit)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sorted(queries):
        if names and not any(name == want or (want.endswith("*") and name.startswith(want[:-1])) for want in names):
            continue
        begin = time.time()
        try:
            if name in sqls:
                problem = difference(spark, queries[name], sqls[name], folder)
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                note = f"rows only: {queries[name](spark, folder).count()}"
        except Exception as error:  # report and go on with the next query
            note = f"ERROR {str(error)[:700]}"
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - begin:6.2f}s {note}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
