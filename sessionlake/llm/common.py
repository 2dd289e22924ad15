"""What the operators of this subpackage share: tables, batches cut by bytes, vector blocks, groups of linked keys."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.session import cut_lineage

PIECE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES, measure=pc.binary_length) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text, or of what else is measured; a longer text comes alone."""
    for batch in batches:
        sizes = measure(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]))
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if end > start:
                yield batch.slice(start, end - start)


def lean(run):
    """The same mapInArrow function, which gives free memory back to the system when its task ends: worker processes outlive their tasks, and
    what one stage has used once would stay beside what the next one needs."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux keeps freed blocks otherwise
            trim(0)

    return wrapped


def bucket_count(docs: DataFrame, text: str, each: int) -> int:
    """A power of two of buckets, each for about so many bytes of text."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(16, 1 << max(0, math.ceil(math.log2(max(1, size) / each))))


def by_bucket(at: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs in `at`, and where."""
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b]:cuts[b + 1]]


def free_name(columns: list[str], wanted: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def join_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch's links (columns a, b): same groups, fewer rows."""
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        root: dict[int, int] = {}

        def top(x: int) -> int:
            seen = []
            while (up := root.setdefault(x, x)) != x:
                seen.append(x)
                x = up
            for y in seen:
                root[y] = x
            return x

        for x, y in zip(a, b):
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        rows = [(x, top(x)) for x in root if root[x] != x]
        yield pa.record_batch({"a": pa.array([x for x, _ in rows], pa.int64()), "b": pa.array([y for _, y in rows], pa.int64())})


def smallest_linked(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of links (a, b: long); nodes without links are absent.

    Every round points each node's larger neighbours, then its smaller ones, at the smallest of them, so distances halve and
    a round only moves as many rows as there are links. Rounds end when the links are stars: each node has one link to a
    smaller one, which has none itself. Each round is a checkpoint.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b")
    edges = cut_lineage(links.mapInArrow(join_locally, "a long, b long").distinct())
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            edges.select(F.col("b"), (F.col("b") > F.col("a")).cast("int"), F.lit(1)))
        chained = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)")
        if chained.isEmpty():
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").filter("a != b").distinct())
        edges = cut_lineage(small)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def vector_blocks(vectors: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """keys, block, ids (array<long>), vectors (array<array<double>>): vectors (keys not null, id, vector) in blocks of about `rows`,
    however many share the keys. The count is made first, on keys alone."""
    parts = vectors.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("_parts"))
    dealt = vectors.join(parts, keys).select(*keys, "id", "vector", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("block"))
    return (dealt.groupBy(*keys, "block").agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
            .select(*keys, "block", F.col("rows.id").alias("ids"), F.col("rows.vector").alias("vectors")))


def matrix(column, i: int) -> np.ndarray:
    """Row i of a list<list<double>> column as a matrix."""
    rows = column[i].values
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
