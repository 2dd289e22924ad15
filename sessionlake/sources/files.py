"""Readers, deterministic writers, fingerprints and manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, *, required: Sequence[str] = ()) -> DataFrame:
    """CSV with a header; a byte-order mark is dropped and malformed rows fail the read."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).option("encoding", "UTF-8").schema(schema).csv(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped and a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines a strict read would refuse."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("j"))
    return parsed.filter(F.col(f"j.{CORRUPT}").isNotNull()).select("value")


def read_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A nested JSON document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_table(df: DataFrame, path: str, fmt: str, *, partition: Sequence[str] = (), order: Sequence[str] = (), mode: str = "errorifexists") -> int:
    """Write in a stable order inside each partition and return the number of rows written."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if partition:
        rows = rows.repartition(*partition)
    if order:
        rows = rows.sortWithinPartitions(*partition, *order)
    writer = rows.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition:
        writer = writer.partitionBy(*partition)
    writer.save(path)
    return seen.get["rows"]


CHUNK_BYTES, SPLIT_BYTES, TREE_FAN = 4 << 20, 256 << 20, 4096


class FileChunks(DataSource):
    """Hashes of the files under `path`, read piece by piece: a task holds one chunk in memory, however large its file.

    With `whole` the file is one split and its running SHA-256 comes out at its end (chunk -1); otherwise splits of `split_bytes` are read in parallel and give the
    SHA-256 of every chunk of `chunk_bytes`. Paths are local or those of a store that `pyarrow.fs` opens by its address."""

    @classmethod
    def name(cls) -> str:
        return "file_chunks"

    def schema(self) -> str:
        return "path string, size_bytes long, chunk long, sha256 string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ChunkReader(dict(self.options))


class ChunkSplit(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int) -> None:
        self.path, self.size, self.start, self.end = path, size, start, end


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.whole = options["path"], options.get("whole", "false") == "true"
        self.chunk = int(options.get("chunk_bytes", CHUNK_BYTES))
        self.split = max(1, int(options.get("split_bytes", SPLIT_BYTES)) // self.chunk) * self.chunk

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._open()
        found = store.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        files = [found] if found.is_file else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
        step = lambda f: max(1, f.size) if self.whole else self.split
        return [ChunkSplit(f.path, f.size, at, min(f.size, at + step(f))) for f in files for at in range(0, max(1, f.size), step(f))]

    def read(self, partition: ChunkSplit) -> Iterator[tuple]:
        running = hashlib.sha256()
        with self._open()[0].open_input_file(partition.path) as handle:
            handle.seek(partition.start)
            for at in range(partition.start, max(partition.end, partition.start + 1), self.chunk):
                block = handle.read(min(self.chunk, partition.end - at))
                if self.whole:
                    running.update(block)
                else:
                    yield partition.path, partition.size, at // self.chunk, hashlib.sha256(block).hexdigest()
        if self.whole:
            yield partition.path, partition.size, -1, running.hexdigest()


def file_chunks(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(FileChunks)
    return spark.read.format("file_chunks").options(path=path, **{k: str(v).lower() for k, v in options.items()}).load()


def tree_fingerprints(spark: SparkSession, path: str, *, fan: int = TREE_FAN, **options: object) -> DataFrame:
    """path, size_bytes, tree_sha256: SHA-256 over the digests of up to ``fan`` neighbours, level by level, from chunks read in parallel."""
    nodes = file_chunks(spark, path, **options)
    while True:
        top = nodes.agg(F.max("chunk")).first()[0]
        if not top:
            return nodes.select("path", "size_bytes", F.col("sha256").alias("tree_sha256"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha256"))), lambda n: n["sha256"])
        only = F.col("_n") == 1  # the digest of a lone chunk stands for itself
        nodes = nodes.groupBy("path", "size_bytes", F.floor(F.col("chunk") / fan).alias("chunk")).agg(F.count(F.lit(1)).alias("_n"), listed.alias("_l")).select(
            "path", "size_bytes", "chunk", F.when(only, F.get("_l", F.lit(0))).otherwise(F.sha2(F.array_join("_l", ""), 256)).alias("sha256"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file under a path, each read as a stream by one task."""
    return file_chunks(spark, path, whole=True).select("path", "size_bytes", "sha256")


def verify_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files under a path against ``expected`` (path, sha256): path, sha256, size_bytes. Any missing or different file fails the job that reads them."""
    d = expected.withColumnRenamed("sha256", "_wanted").join(file_fingerprints(spark, path), "path", "left")
    said = F.concat(F.lit("integrity check failed for "), F.col("path"), F.lit(": expected "), F.col("_wanted"), F.lit(", got "), F.coalesce("sha256", F.lit("no file")))
    return d.select("path", F.when(F.coalesce(F.col("sha256") == F.col("_wanted"), F.lit(False)), F.col("sha256")).otherwise(F.raise_error(said)).alias("sha256"), "size_bytes")


def row_hash(df: DataFrame):
    """60 bits of the SHA-256 of a row's columns in order of their names, each as its length and text; the same in every engine."""
    text = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.conv(F.substring(F.sha2(F.concat(*[text(F.col(name)) for name in sorted(df.columns)]), 256), 1, 15), 16, 10)


def table_fingerprint(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row count and an order-insensitive sum of row hashes."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(row_hash(df).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def verified(manifest: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manifest entries whose produced table is missing or differs."""
    a = actual.select(*keys, F.col("rows").alias("_rows"), F.col("fingerprint").alias("_fp"))
    d = manifest.join(a, list(keys), "left")
    problem = F.when(F.col("_fp").isNull(), "missing").when(F.col("_rows") != F.col("rows"), "row_count_differs").when(F.col("_fp") != F.col("fingerprint"), "content_differs")
    return d.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(*keys, "problem")


def resolve_configurations(configs: DataFrame, sources: DataFrame) -> DataFrame:
    """Identity of every configured source: by hash and path, by hash alone, or why not.

    ``configs``: ``config, source, sha256``; ``sources``: ``source, sha256, inspected``.
    """
    by_hash = sources.filter(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.count(F.lit(1)).alias("_matches"), F.min("source").alias("_only"))
    exact = sources.select("source", "sha256").distinct().withColumn("_exact", F.lit(True))
    named = sources.groupBy("source").agg(F.bool_or(~F.col("inspected")).alias("_failed"))
    d = configs.join(by_hash, "sha256", "left").join(exact, ["source", "sha256"], "left").join(named, "source", "left")
    status = (F.when(F.col("_exact"), "verified").when(F.col("_matches") == 1, "verified_renamed_source").when(F.col("_matches") > 1, "ambiguous_duplicate_sources")
              .when(F.col("_failed"), "configured_source_inspection_failed").when(F.col("_failed").isNotNull(), "configured_source_hash_mismatch").otherwise("source_missing"))
    return d.select("config", status.alias("identity_status"), F.when(F.col("_exact"), F.col("source")).when(F.col("_matches") == 1, F.col("_only")).alias("resolved_source"),
                    F.coalesce("_matches", F.lit(0)).cast("long").alias("matching_sources"))


def unconfigured(configs: DataFrame, sources: DataFrame) -> DataFrame:
    return sources.join(configs.select("sha256").distinct(), "sha256", "left_anti").select("source")


def confirmed_empty(rows: DataFrame, summaries: DataFrame, key: str, events: str = "xp_jump_events") -> DataFrame:
    """Runs without rows whose summary does not confirm that there were none."""
    present = rows.select(key).distinct()
    return summaries.join(present, key, "left_anti").filter(~F.coalesce(F.col(events) == 0, F.lit(False))).select(key)


def sample_plan(recordings: DataFrame, checkpoints: Sequence[int], *, duration: str, onset: str, relative: Sequence[int]) -> DataFrame:
    """Checkpoints inside the recording, plus those relative to the onset of play."""
    fixed = F.array(*[F.lit(c).cast("long") for c in checkpoints])
    late = F.array(*[F.col(onset) + F.lit(r) for r in relative])
    times = F.explode(F.array_distinct(F.concat(fixed, late))).alias("second")
    return recordings.select("*", times).filter((F.col("second") >= 0) & (F.col("second") < F.col(duration)))


def decimated(frames: DataFrame, *, period_ms: float, start_ms: int = 0, time: str = "t_ms", frame: str = "frame", keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """At most one frame per sampling period, the first of each, without drift."""
    slot = F.floor((F.col(time) + 0.5 - start_ms) / period_ms).cast("long")
    d = frames.withColumn("_slot", slot).filter("_slot >= 0")
    return d.groupBy(*keys, "_slot").agg(F.min_by(F.struct(*frames.columns), frame).alias("_r")).select("_r.*")


def page(df: DataFrame, order: Sequence[str], start: int, size: int) -> DataFrame:
    """Rows ``start .. start + size`` of a stable order."""
    return df.orderBy(*order).offset(start).limit(size)
