"""Near-duplicate vectors within a label by an inverted multi-index, with exact verification of every link.

The index splits unit vectors into halves and quantizes each with its own codebook; a cell is a pair of codewords. Codebooks
are fitted on a bounded sample (SAMPLE_ROWS rows of lowest id hash), every vector is indexed. A vector visits the cells of the
product grid in order of the sum of its two half distances, as multi-sequence traversal does, and stops by a number of cells that is the smallest
power of two from 4 on that reaches TARGET_RECALL. Recall is measured on the links of QUERY_ROWS rows with all rows of the table (Spark deals out the
rows, each task holds the queries): as the mean over queries, and as the mean over groups of links (a query with n links weighs 1 / (n + 1)), so a
crowd neither decides alone nor is passed over. Where these are fewer than ENOUGH groups, cells must also be found by partners made at the threshold's
very cosine, in random directions. Vectors in a visited cell are verified by their cosine in double precision.

Equal vectors of one label are one node with a count, so a crowd of copies costs one row. A crowded cell is dealt into blocks,
for visitors and residents alike; each pair of blocks is one task's work.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without label, have no links
and are their own component; different dimensions never link; rows that repeat id and vector count as other vectors of the
same id; a null id is its own component with a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import matrix, smallest_linked, vector_blocks
from sessionlake.llm.topk import usable
from sessionlake.session import cut_lineage

THRESHOLD = 0.93
TARGET_RECALL = 0.99
SAMPLE_ROWS = 20_000
QUERY_ROWS = 2048  # whose links with all rows measure the recall
ENOUGH = 200  # groups of links that are evidence by themselves
LEVELS = 32  # powers of two of visited cells
SLACK = 1e-12  # sums of half distances this close count as equal
CELL_ROWS = 32  # residents of a cell aimed at, over all labels
MAX_CODES = 1024  # per half
BLOCK_ROWS = 2048


def _fit(rows: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's codebook; empty codes keep their place."""
    rng = np.random.Generator(np.random.PCG64(7))
    book = rows[rng.choice(len(rows), min(codes, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((book * book).sum(1) - 2 * rows @ book.T, axis=1)
        sums = np.zeros_like(book)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(book))
        book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return book


def _half_distances(x: np.ndarray, books) -> tuple[np.ndarray, np.ndarray]:
    half = books[0].shape[1]
    out = []
    for part, book in ((x[:, :half], books[0]), (x[:, half:], books[1])):
        out.append((part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * part @ book.T)
    return out[0], out[1]


def nearest_cells(x: np.ndarray, books, count: int) -> np.ndarray:
    """The `count` cells of least summed half distance, nearest first.

    In the order of both sorted half lists, cell (i, j) comes after every cell (i' <= i, j' <= j), so only cells with
    (i + 1) * (j + 1) <= count can be among the first `count`; those few are summed and sorted.
    """
    a, b = _half_distances(x, books)
    n_a, n_b = a.shape[1], b.shape[1]
    count = min(count, n_a * n_b)
    i, j = np.divmod(np.arange(min(count, n_a) * min(count, n_b)), min(count, n_b))
    i, j = i[(i + 1) * (j + 1) <= count], j[(i + 1) * (j + 1) <= count]
    order_a, order_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    sums = np.take_along_axis(a, order_a, 1)[:, i] + np.take_along_axis(b, order_b, 1)[:, j]
    first = np.argsort(sums, axis=1, kind="stable")[:, :count]
    rows = np.arange(len(x))[:, None]
    return order_a[rows, i[first]] * n_b + order_b[rows, j[first]]


def fit_books(sample: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves for a table of so many rows."""
    half = max(1, sample.shape[1] // 2)
    codes = int(min(MAX_CODES, max(1, 2 ** round(np.log2(max(1.0, total / CELL_ROWS)) / 2))))
    return _fit(sample[:, :half], codes), _fit(sample[:, half:], codes) if sample.shape[1] > half else np.zeros((1, 0))


def _levels(a: np.ndarray, b: np.ndarray, sorted_b: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Least k with a cell among the first 2 ** k of a vector with these half distances, each cell of `cells`."""
    sums = a[cells // len(b)] + b[cells % len(b)]
    a = a[a <= sums.max() - sorted_b[0] + SLACK]
    place = np.searchsorted(sorted_b, sums[:, None] - a + SLACK, "right").sum(1)
    return np.ceil(np.log2(np.maximum(place, 1))).astype(np.int64)


class Probe:
    """Queries of one dimension, and how many cells a link between a query and another row takes to be found from either end."""

    def __init__(self, books, queries: np.ndarray, labels: np.ndarray, nodes: np.ndarray):
        self.books, self.queries, self.labels, self.nodes = books, queries, labels, nodes
        self.home = nearest_cells(queries, books, 1)[:, 0]
        self.distances = None

    def levels(self, x: np.ndarray, q: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Level of each link between query q and row y of x; q ascending."""
        if self.distances is None:
            left, right = _half_distances(self.queries, self.books)
            self.distances = left, right, np.sort(right, axis=1)
        used, y = np.unique(y, return_inverse=True)
        x = x[used]
        home, out = nearest_cells(x, self.books, 1)[:, 0], np.empty(len(q), np.int64)
        edges = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1], [True])))
        for s, e in zip(edges[:-1], edges[1:]):
            cells, at = np.unique(home[y[s:e]], return_inverse=True)
            out[s:e] = _levels(*(d[q[s]] for d in self.distances), cells)[at]
        # The other end is asked where the query's own cells do not do at the least number of visits.
        late = np.flatnonzero(out > 2)
        late = late[np.argsort(y[late], kind="stable")]
        edges = np.flatnonzero(np.concatenate(([True], y[late][1:] != y[late][:-1], [True]))) if len(late) else np.zeros(0, np.int64)
        for s, e in zip(edges[:-1], edges[1:]):
            k = y[late[s]]
            left, right = _half_distances(x[k:k + 1], self.books)
            cells, at = np.unique(self.home[q[late[s:e]]], return_inverse=True)
            out[late[s:e]] = np.minimum(out[late[s:e]], _levels(left[0], right[0], np.sort(right[0]), cells)[at])
        return np.maximum(out, 2)

    def count(self, x: np.ndarray, labels: np.ndarray, nodes: np.ndarray, threshold: float, into: np.ndarray) -> None:
        """Add the links of all queries with the rows x to into[query, level]."""
        q, y = np.nonzero((self.queries @ x.T >= threshold) & (self.labels[:, None] == labels) & (self.nodes[:, None] != nodes))
        if len(q):
            np.add.at(into, (q, self.levels(x, q, y)), 1)

    def planted(self, threshold: float) -> np.ndarray:
        """counts[query, level] of one made partner for each query, at the threshold's cosine in a random direction."""
        aside = np.random.Generator(np.random.PCG64(5)).normal(size=self.queries.shape)
        aside -= (aside * self.queries).sum(1)[:, None] * self.queries
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-300)[:, None]
        each, out = np.arange(len(self.queries)), np.zeros((len(self.queries), LEVELS), np.int64)
        out[each, self.levels(threshold * self.queries + np.sqrt(max(0.0, 1 - threshold * threshold)) * aside, each, each)] = 1
        return out


def visits_for(counts: np.ndarray, planted, most: int, target: float = TARGET_RECALL) -> int:
    """Cells to visit by counts[query, level] of links; `planted` gives such counts of made links, asked for when links are few (None: all rows are queries)."""
    def curves(counts):
        found, links = np.cumsum(counts, axis=1)[counts.sum(1) > 0], counts.sum(1)[counts.sum(1) > 0]
        weight = 1 / (links + 1)
        share = found / links[:, None]
        return [share.mean(0), weight @ share / weight.sum()] if len(links) else [], weight.sum() ** 2 / (weight * weight).sum() if len(links) else 0
    recall, groups = curves(counts)
    if groups < ENOUGH and planted is not None:
        recall += curves(planted())[0]
    level = max((int(np.argmax(r >= target)) for r in recall), default=2)
    return min(2 ** max(2, level), most)


def fit_indexes(nodes: DataFrame, sizes: dict[int, int], threshold: float = THRESHOLD) -> dict:
    """For each dimension, codebooks and the number of cells to visit, of nodes (dim, label, v, id, node)."""
    probes = {}
    for dim, total in sizes.items():
        sample = nodes.filter(F.col("dim") == dim).orderBy(F.xxhash64("id", "v"), "node").limit(SAMPLE_ROWS + QUERY_ROWS).select("v", F.xxhash64("label").alias("l"), "node").collect()
        x = np.array([r["v"] for r in sample])
        asked = slice(max(0, len(x) - QUERY_ROWS), None)
        probes[dim] = Probe(fit_books(x[:SAMPLE_ROWS], total), x[asked].copy(), np.array([r["l"] for r in sample[asked]]), np.array([r["node"] for r in sample[asked]]))
        del sample, x
    shared = nodes.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.intersect1d(dims, list(shared.value)).tolist():
                part = batch.filter(pa.array(dims == dim))
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                labels, numbers, probe = part.column("l").to_numpy(), part.column("node").to_numpy(), shared.value[dim]
                into = counts.setdefault(dim, np.zeros((len(probe.queries), LEVELS), np.int64))
                for start in range(0, len(part), 1024):
                    probe.count(flat[start:start + 1024], labels[start:start + 1024], numbers[start:start + 1024], threshold, into)
        for dim, into in counts.items():
            q, level = np.nonzero(into)
            yield pa.record_batch({"dim": pa.array(np.full(len(q), dim), pa.int32()), "q": pa.array(q, pa.int32()), "level": pa.array(level, pa.int32()), "n": pa.array(into[q, level])})

    met = nodes.select("dim", "node", "v", F.xxhash64("label").alias("l")).mapInArrow(run, "dim int, q int, level int, n long")
    counts = {dim: np.zeros((len(probe.queries), LEVELS), np.int64) for dim, probe in probes.items()}
    for dim, q, level, n in met.groupBy("dim", "q", "level").agg(F.sum("n")).collect():
        counts[dim][q, level] = n
    return {dim: (probe.books, visits_for(counts[dim], (lambda probe=probe: probe.planted(threshold)) if sizes[dim] > len(probe.queries) else None, len(probe.books[0]) * len(probe.books[1])))
            for dim, probe in probes.items()}


def near_groups(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    fits = usable(F.col("v")) & F.col("label").isNotNull()
    # Very small and very large vectors are scaled by their greatest component first.
    rows = rows.withColumn("v", F.when(fits, F.transform("v", lambda x: F.try_divide(x, F.array_max(F.transform("v", F.abs))))))
    rows = rows.withColumn("length", norm).withColumn("v", F.when(F.col("length") > 0, F.transform("v", lambda x: x / F.col("length")))).drop("length")
    rows = cut_lineage(rows.withColumn("fits", F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))))
    good = rows.filter("fits").withColumn("dim", F.size("v"))
    nodes = good.groupBy("dim", "label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    sizes = {row["dim"]: row["n"] for row in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    shared = spark.sparkContext.broadcast(fit_indexes(nodes, sizes, threshold))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                for start in range(0, len(part), 1024):
                    x = flat[start:start + 1024]
                    # Dimensions beyond the 64 most frequent have one cell.
                    cells = nearest_cells(x, *shared.value[dim]) if dim in shared.value else np.zeros((len(x), 1), np.int64)
                    offsets = pa.array(np.arange(len(x) + 1) * cells.shape[1], pa.int32())
                    yield pa.record_batch({"node": part.column("node").slice(start, len(x)), "cells": pa.ListArray.from_arrays(offsets, pa.array(cells.ravel(), pa.int64()))})

    cells = nodes.select("dim", "node", "v").mapInArrow(locate, "node long, cells array<long>")
    placed = cut_lineage(nodes.join(cells, "node"))
    resident = vector_blocks(placed.select("dim", "label", F.col("cells")[0].alias("cell"), F.col("node").alias("id"), F.col("v").alias("vector")), ["dim", "label", "cell"], BLOCK_ROWS)
    visitor = vector_blocks(placed.select("dim", "label", F.explode("cells").alias("cell"), F.col("node").alias("id"), F.col("v").alias("vector")), ["dim", "label", "cell"], BLOCK_ROWS)
    visitor = visitor.select("dim", "label", "cell", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    work = visitor.join(resident, ["dim", "label", "cell"]).select("q_ids", "q_vectors", "ids", "vectors")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, ids = batch.column("q_ids")[r].values.to_numpy(), batch.column("ids")[r].values.to_numpy()
                x, y = np.nonzero(matrix(batch.column("q_vectors"), r) @ matrix(batch.column("vectors"), r).T >= threshold)
                a, b = q_ids[x], ids[y]
                a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = cut_lineage(work.mapInArrow(verify, "a long, b long").distinct())
    groups = smallest_linked(links)
    ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = nodes.select(F.col("node").alias("b"), "copies")
    linked = ends.join(weights, "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    joined = nodes.join(groups, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    info = joined.join(lowest, "root").select("label", F.col("v").alias("v"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    key = F.xxhash64("label", "v")
    left, right = rows.withColumn("key", key).alias("l"), info.withColumn("key", key).alias("r")
    same = (F.col("l.key") == F.col("r.key")) & F.col("l.fits") & (F.col("l.label") == F.col("r.label")) & (F.col("l.v") == F.col("r.v"))
    return left.join(right, same, "left").select(F.col("l.id").alias("id"), F.coalesce("r.n_links", F.lit(0)).cast("long").alias("n_links"),
                                                 F.coalesce("r.component_id", "l.id").alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
