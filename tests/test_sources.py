"""Readers, writers, fingerprints and observers."""

import hashlib
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.functions.observers import observe, register_observer
from sessionlake.sources import files

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("name", T.StringType())])


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿event_id,name\n1,x\n2,y\n".encode())
    out = files.read_csv(spark, str(path), SCHEMA, required=["event_id"])
    assert [tuple(r) for r in out.orderBy("event_id").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(path), SCHEMA, required=["missing"])


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"event_id": 1, "name": "x"}\n\n{"event_id": 2, "name": "y"}\n')
    assert files.read_jsonl(spark, str(path), SCHEMA).count() == 2
    path.write_text('{"event_id": 1}\n{oops\n')
    assert [r["value"] for r in files.malformed_jsonl(spark, str(path), SCHEMA).collect()] == ["{oops"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(path), SCHEMA).collect()


def test_document(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"version": "1", "events": [{"code": "a"}, {"code": "b"}]}, indent=2))
    doc = files.read_document(spark, str(path))
    assert [r["code"] for r in doc.select(F.explode("events.code").alias("code")).collect()] == ["a", "b"]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_write_returns_the_row_count(spark, tmp_path, fmt):
    df = spark.range(100).select((F.col("id") % 3).alias("session_id"), "id")
    path = str(tmp_path / fmt)
    assert files.write_table(df, path, fmt, partition=["session_id"], order=["id"]) == 100
    back = spark.read.format(fmt).option("header", True).load(path)
    assert back.count() == 100


def test_fingerprints(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    row = files.file_fingerprints(spark, str(tmp_path / "f")).first()
    assert row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    same = df.orderBy(F.desc("id")).repartition(3)
    assert files.table_fingerprint(df).first() == files.table_fingerprint(same).first()
    assert files.table_fingerprint(df).first() != files.table_fingerprint(df.filter("id <> 7")).first()


def test_observer(spark):
    def bright(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"observation_id": batch["frame"].astype(str), "frame_number": batch["frame"], "value_num": batch["luma"]})

    register_observer("bright", bright)
    features = spark.createDataFrame([(1, 0.5), (2, 0.7)], "frame long, luma double")
    out = observe(features, "bright")
    assert sorted((r["frame_number"], r["value_num"]) for r in out.collect()) == [(1, 0.5), (2, 0.7)]


def test_file_fingerprints_of_large_files(spark, tmp_path):
    """A file over the limit of one cell is hashed piece by piece; its tree hash comes from chunks in parallel."""
    large, small, blank = tmp_path / "in" / "large.bin", tmp_path / "in" / "sub" / "small.bin", tmp_path / "in" / "blank.bin"
    small.parent.mkdir(parents=True)
    size = (2 << 30) + 5_000_000
    with large.open("wb") as handle:
        handle.write(b"head")
        handle.truncate(size)  # takes no disk
    small.write_bytes(b"some bytes")
    blank.write_bytes(b"")
    step = 64 << 20
    running, digests, zeros = hashlib.sha256(b"head"), [], bytes(step)
    for at in range(0, size, step):
        block = zeros[:min(step, size - at)]
        if at == 0:
            block = b"head" + block[4:]
        running.update(block[4:] if at == 0 else block)
        digests.append(hashlib.sha256(block).hexdigest())
    found = {os.path.basename(r.path): (r.size_bytes, r.sha256) for r in files.file_fingerprints(spark, str(tmp_path / "in")).collect()}
    assert found == {"large.bin": (size, running.hexdigest()), "small.bin": (10, hashlib.sha256(b"some bytes").hexdigest()), "blank.bin": (0, hashlib.sha256(b"").hexdigest())}
    nodes = digests
    while len(nodes) > 1:
        runs = [nodes[i:i + 4] for i in range(0, len(nodes), 4)]
        nodes = [run[0] if len(run) == 1 else hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
    trees = {os.path.basename(r.path): r.tree_sha256 for r in files.tree_fingerprints(spark, str(tmp_path / "in"), fan=4, chunk_bytes=step).collect()}
    assert trees == {"large.bin": nodes[0], "small.bin": found["small.bin"][1], "blank.bin": found["blank.bin"][1]}
    assert files.file_chunks(spark, str(large), chunk_bytes=step).count() == len(digests)


def test_verify_files(spark, tmp_path):
    path = tmp_path / "a.bin"
    path.write_bytes(b"abc")
    wanted = lambda sha: spark.createDataFrame([(str(path), sha)], "path string, sha256 string")
    assert files.verify_files(spark, str(path), wanted(hashlib.sha256(b"abc").hexdigest())).first().size_bytes == 3
    with pytest.raises(Exception, match="integrity check failed"):
        files.verify_files(spark, str(path), wanted("0" * 64)).collect()
    with pytest.raises(Exception, match="nowhere"):
        files.file_fingerprints(spark, str(tmp_path / "nowhere")).collect()
