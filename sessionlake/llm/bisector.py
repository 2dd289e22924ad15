"""Centroid clustering by a tournament of bisectors over integer vectors.

The hyperplane half way between two centroids a < b tells which is nearer: v is nearer to b exactly when v * 2(b - a) > |b|^2 - |a|^2.
Normals and limits are whole numbers made once a round; k - 1 sign tests leave one centroid, and zero favours the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NARROW = 1 << 20  # whole numbers up to here give products and sums that doubles hold exactly
LIMB = 30
LONGEST = (1 << 63) - 1
ROWS = 4096
Centroids = list[list[int]]


def usable(vectors: DataFrame, id: str, vector: str, dims: int) -> DataFrame:
    """id, vector: rows whose vector has `dims` components, none null, NaN or infinite."""
    infinite = float("inf")
    odd = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return vectors.filter((F.size(vector) == dims) & ~odd).select(F.col(id).alias("id"), F.col(vector).alias("vector"))


def whole(batch: pa.RecordBatch, dims: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and floor(scale * x), as doubles that hold whole numbers, a few thousand rows at a time."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield part.column("id"), np.floor(_times(flat, scale)).reshape(-1, dims)


def _times(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = x * float(scale)
    return np.where(np.isinf(y), x, y)  # only doubles near the end of their range: left unscaled, they stay finite


def exact(x: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers."""
    out = np.empty(x.size, dtype=object)
    out[:] = [int(v) for v in x.ravel()]
    return out.reshape(x.shape)


class Tournament:
    """Normals 2(b - a) and limits |b|^2 - |a|^2 of every pair of centroids a < b."""

    def __init__(self, centroids: Centroids) -> None:
        c = np.array(centroids, dtype=object)
        self.narrow = bool(max(abs(x) for row in centroids for x in row) <= NARROW)
        lengths = (c * c).sum(axis=1)
        self.centroids, self.normals, self.limits = c, 2 * (c[None, :] - c[:, None]), lengths[None, :] - lengths[:, None]
        self.whole = (self.centroids, self.normals, self.limits)
        self.plain = tuple(a.astype(np.float64) for a in self.whole) if self.narrow else self.whole

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each row's nearest centroid, and the exact squared distance to it."""
        wide = np.abs(x).max(axis=1, initial=0) > NARROW if self.narrow else np.ones(len(x), bool)
        winner, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        for rows, (centroids, normals, limits), cast in ((~wide, self.plain, None), (wide, self.whole, exact)):
            if not rows.any():
                continue
            y = cast(x[rows]) if cast else x[rows]
            best = np.zeros(len(y), np.int64)
            for rival in range(1, len(centroids)):
                beaten = ((normals[best, rival] * y).sum(axis=1) - limits[best, rival]) > 0
                best[beaten.astype(bool)] = rival
            off = y - centroids[best]
            winner[rows], distance[rows] = best, exact((off * off).sum(axis=1))
        return winner, distance


def limbs(number: int) -> Iterator[tuple[int, int]]:
    """A whole number of any size as (place, digit) to the base 2^30; the digits carry its sign, so digits of many numbers may be added."""
    sign, rest, place = (-1 if number < 0 else 1), abs(number), 0
    while rest:
        yield place, sign * (rest & ((1 << LIMB) - 1))
        rest, place = rest >> LIMB, place + 1


def cluster_sums(kept: DataFrame, centroids: Centroids, dims: int, scale: int) -> dict[tuple[int, int], int]:
    """By (cluster, dimension): sum of components; dimension `dims` counts the vectors, `dims` + 1 sums their distances.

    Each task adds its own rows and sends one line for each cluster and dimension, so what meets in a sum is tasks, not vectors, and
    what reaches the driver is k * (dims + 2) numbers."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contest, k = Tournament(centroids), len(centroids)
        total = np.zeros((k, dims + 2), dtype=object)
        for batch in batches:
            for _, x in whole(batch, dims, scale):
                winner, distance = contest.nearest(x)
                small = np.abs(x).max(initial=0) <= NARROW
                for c in np.unique(winner).tolist():
                    own = x[winner == c]
                    total[c, :dims] += exact(own.sum(axis=0)) if small else exact(own).sum(axis=0)
                    total[c, dims] += len(own)
                    total[c, dims + 1] += distance[winner == c].sum()
        lines = [(c, d, place, digit) for c in range(k) for d in range(dims + 2) for place, digit in limbs(int(total[c, d]))]
        yield pa.record_batch({name: pa.array([line[i] for line in lines], kind) for i, (name, kind) in enumerate((("c", pa.int32()), ("d", pa.int32()), ("place", pa.int32()), ("digit", pa.int64())))})

    found: dict[tuple[int, int], int] = {}
    for c, d, place, digit in kept.mapInArrow(sums, "c int, d int, place int, digit long").groupBy("c", "d", "place").agg(F.sum("digit")).collect():
        found[c, d] = found.get((c, d), 0) + (digit << (LIMB * place))
    return found


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector with `dims` finite components.

    Components become floor(scale * x). Centroids start as the k vectors whose ids have the smallest sha256 of `1:<id>`; rows of one id
    are ordered by their vectors. Rows without id are clustered but start no centroid before all others are used. With fewer than k vectors
    there are as many centroids. Repeated rows count once each. A centroid without vectors stays. All sums are exact for components of
    any size; a distance or inertia beyond a long is given as the largest long. Without vectors the result is empty."""
    kept = usable(vectors, id, vector, dims)
    name = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    starts = kept.select(name.alias("name"), F.col("vector").cast("array<double>").alias("vector")).orderBy(F.col("name").asc_nulls_last(), "vector").limit(k).collect()
    centroids = [[int(v) for v in np.floor(_times(np.array(row.vector), scale))] for row in starts]
    kind = kept.schema["id"].dataType.simpleString()
    layout = f"`{id}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], layout)
    for _ in range(rounds):
        sums = cluster_sums(kept, centroids, dims, scale)
        centroids = [[sums.get((c, d), 0) // sums[c, dims] for d in range(dims)] if sums.get((c, dims)) else centroid for c, centroid in enumerate(centroids)]
    sums = cluster_sums(kept, centroids, dims, scale)
    inertia = [sums.get((c, dims + 1), 0) for c in range(len(centroids))]
    digests = [centroid_digest(c) for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contest = Tournament(centroids)
        own = np.array([min(x, LONGEST) for x in inertia], np.int64)
        everything = min(sum(inertia), LONGEST)
        for batch in batches:
            for ids, x in whole(batch, dims, scale):
                winner, distance = contest.nearest(x)
                yield pa.record_batch({id: ids, "cluster": pa.array(winner.astype(np.int32)), "distance": pa.array([min(d, LONGEST) for d in distance.tolist()], pa.int64()), "cluster_inertia": pa.array(own[winner]),
                                       "inertia": pa.array(np.full(len(winner), everything, np.int64)), "centroid_sha256": pa.array([digests[c] for c in winner.tolist()], pa.string())})

    return kept.mapInArrow(assign, layout)
