"""A training corpus from raw documents: quality, repeated lines, near copies, source weights, token ids.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; run() writes each result as Parquet
in the shared checkpoint folder and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import bpe, jaccard, lines, mixing, quality
from sessionlake.llm.common import free_name, table
from sessionlake.llm.queries import WEIGHTS, vocabulary
from sessionlake.session import ensure_checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score, keep = free_name(docs.columns, "_score"), free_name(docs.columns, "_keep")
    return quality.score_quality(docs, model, score, keep).filter(keep).select(*(f"`{c}`" for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came earlier."""
    return lines.dedup_lines(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    drawn = mixing.mix_sources(docs, WEIGHTS)
    columns = docs.columns
    key, times, twin, turn = (free_name(columns, c) for c in ("_key", "_times", "_twin", "_turn"))
    marked = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    counts = drawn.select(F.col("key").alias(twin), F.size("draws").alias(times)).groupBy(twin).agg(F.max(times).alias(times)).filter(F.col(times) > 0)
    return (marked.join(counts, marked[key] == counts[twin]).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(f"`{c}`" for c in columns)))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, and whether the ids decode to the text's bytes."""
    codec = vocabulary(spark)
    decoded = bpe.encode(docs.select("doc_id", "source", "text"), codec, decoded="decoded", cache_bytes=CACHE_BYTES)
    return decoded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")).alias("round_trip"))


CACHE_BYTES = 16 << 20  # of pre-tokens in a worker: executors that have run the earlier stages have less room than those of a job of its own

STAGES = [("quality classifier", keep_good), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_copies), ("mixing", mix), ("byte-level BPE", tokenize)]

ORACLE_SQL = None  # a trained classifier and hashed draws are not expressible


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
    return docs
