"""Exact top-k inner products by norm buckets with pruning from local cosine thresholds.

Candidates are put into buckets of similar length (bounds are quantiles of all lengths) and dealt, however large a bucket is,
into blocks of bounded size; within a block they are sorted by length. Queries travel in blocks too. First each query block
meets the block of longest candidates of its dimension, which gives every query a lower bound for its k-th score. Then it meets every
block: with bound t, query length |q| and the block's greatest length m, a candidate of unit direction c must reach the
cosine t / (|q| m). If that exceeds 1 the block is skipped; if it is high, the coordinate in which the query is largest
bounds the candidate's coordinate on both sides; otherwise only candidates of length t / |q| or more stay. What is left is
multiplied out exactly. Only k rows per query and block leave a task, and they are merged by a partial aggregate.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; queries meet candidates of
their own dimension only; a row never meets itself (same id); rows of equal id count once each, as candidates and as
queries, so a query row that stands twice has its k ranks twice; ties go to the smaller id; with fewer candidates all are returned. Components must be whole numbers whose products sum below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import matrix, vector_blocks
from sessionlake.session import cut_lineage

BUCKETS = 8
CANDIDATE_ROWS = 4096
QUERY_ROWS = 256
COORDINATE_COSINE = 0.6  # local thresholds from here on prune by a coordinate, below by length


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))


def _search(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int):
    """(query row, candidate id, score) of up to k candidates per query that reach the query's bound."""
    length = np.sqrt((c * c).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    c, c_ids, length = c[order], c_ids[order], length[order]
    unit = c / np.where(length > 0, length, 1)[:, None]
    q_length = np.sqrt((q * q).sum(axis=1))
    slack = 1e-9
    for i in range(len(q)):
        at = None
        if np.isfinite(bound[i]) and bound[i] > 0 and q_length[i] > 0:
            local = bound[i] / (q_length[i] * length[0]) if length[0] > 0 else np.inf
            if local > 1 + slack:
                continue
            reach = int(np.searchsorted(-length, -(bound[i] / q_length[i]) * (1 - slack), "right"))
            at = np.arange(reach)
            if local >= COORDINATE_COSINE:
                f = int(np.argmax(np.abs(q[i])))
                x, t = q[i, f] / q_length[i], min(local, 1.0)
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + slack
                low = x * t - spread if x >= -t else -1 - slack
                high = x * t + spread if x <= t else 1 + slack
                near = unit[:reach, f]
                at = at[(near >= low) & (near <= high)]
        scores = c @ q[i] if at is None else c[at] @ q[i]
        ids = c_ids if at is None else c_ids[at]
        good = (scores >= bound[i]) & (ids != q_ids[i])
        scores, ids = scores[good], ids[good]
        if len(scores) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            stay = scores >= edge
            scores, ids = scores[stay], ids[stay]
        best = np.lexsort((ids, -scores))[:k]
        for b in best:
            yield i, int(ids[b]), int(scores[b])


def top_k(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector: str = "embedding",
          buckets: int = BUCKETS, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), id, score for every query row against every other row. A query row is its place in its block, not its id."""
    own = vectors.filter(usable(F.col(vector))).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
                                                       F.coalesce(is_query, F.lit(False)).alias("asks"))
    own = own.filter("id is not null").withColumn("dim", F.size("vector")).withColumn("length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
    bounds = own.groupBy("dim").agg(F.percentile_approx("length", [i / buckets for i in range(1, buckets)], 10_000).alias("bounds"))
    bucketed = own.join(bounds, "dim").withColumn("bucket", F.size(F.filter("bounds", lambda b: b < F.col("length"))))
    candidates = cut_lineage(vector_blocks(bucketed.select("dim", "bucket", "id", "vector"), ["dim", "bucket"], candidate_rows))
    queries = vector_blocks(own.filter("asks").select("dim", "id", "vector"), ["dim"], query_rows)
    queries = cut_lineage(queries.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))

    def pair(blocks: DataFrame, asked: DataFrame) -> DataFrame:
        """Each query block beside each of the blocks of its dimension, joined on the block's own key."""
        keys = blocks.groupBy("dim").agg(F.collect_list(F.struct("bucket", "block")).alias("places"))
        sent = asked.join(keys, "dim").withColumn("place", F.explode("places")).drop("places")
        sent = sent.withColumns({"bucket": F.col("place.bucket"), "block": F.col("place.block")}).drop("place")
        return sent.join(blocks, ["dim", "bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids = batch.column("q_ids")[r].values.to_numpy()
                bound = batch.column("q_bounds")[r].values.to_numpy(zero_copy_only=False)
                found = list(_search(matrix(batch.column("q_vectors"), r), q_ids, bound, matrix(batch.column("vectors"), r), batch.column("ids")[r].values.to_numpy(), k))
                rows = np.array([i for i, _, _ in found], dtype=np.int64)
                yield pa.record_batch({"query_id": pa.array(q_ids[rows], pa.int64()), "q_row": pa.array(rows, pa.int32()), "q_block": pa.array(np.full(len(rows), batch.column("q_block")[r].as_py()), pa.int32()),
                                       "dim": pa.array(np.full(len(rows), batch.column("dim")[r].as_py()), pa.int32()),
                                       "id": pa.array([x for _, x, _ in found], pa.int64()), "score": pa.array([s for _, _, s in found], pa.int64())})

    schema = "query_id long, q_row int, q_block int, dim int, id long, score long"
    columns = ["dim", "q_block", "q_ids", "q_vectors", "q_bounds", "ids", "vectors"]
    unknown = queries.withColumn("q_bounds", F.transform("q_ids", lambda _: F.lit(float("-inf"))))
    first = candidates.groupBy("dim").agg(F.max(F.struct("bucket", F.size("ids").alias("n"), "block")).alias("top"))
    first = candidates.join(first.select("dim", F.col("top.bucket").alias("bucket"), F.col("top.block").alias("block")), ["dim", "bucket", "block"], "left_semi")
    seeds = pair(first, unknown).select(*columns).mapInArrow(run, schema)
    kth = seeds.groupBy("dim", "q_block", "q_row").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    known = kth.filter(F.col("n") >= k).groupBy("dim", "q_block").agg(F.map_from_entries(F.collect_list(F.struct("q_row", "low"))).alias("lows"))
    bounded = (queries.join(known, ["dim", "q_block"], "left")
               .withColumn("q_bounds", F.transform("q_ids", lambda _, i: F.coalesce(F.try_element_at("lows", i).cast("double"), F.lit(float("-inf"))))).drop("lows"))
    found = pair(candidates, bounded).select(*columns).mapInArrow(run, schema)
    best = found.groupBy("dim", "q_block", "q_row", "query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))
