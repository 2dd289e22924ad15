"""Byte-level BPE encoding and decoding with a minimal perfect hash over the vocabulary and a heap for the rest.

encode: a text is cut by the pattern into pre-tokens. A pre-token that is itself in the vocabulary is resolved by one probe of
a minimal perfect hash. Any other is merged: its bytes are a linked list, the adjacent pairs wait in a heap ordered by rank and
place, and the lowest pair is joined until no pair is in the vocabulary; O(n log n) in the length of the pre-token. Results
for recent pre-tokens are kept in two bounded dictionaries per worker process.

Defined cases: a null or empty text has no ids and decodes to empty bytes; null ids decode to null; repeated rows are encoded
each; other columns pass through; an existing column of the result's name is replaced.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import free_name, lean, pieces

MAX_VOCABULARY = 2_000_000
CACHE_BYTES = 96 << 20  # of recent pre-tokens in every worker process: more memory saves merges, the ids are the same
ENTRY_BYTES = 200  # a text, its ids and a dictionary slot, besides their characters and ids
LONG_PRETOKEN = 100  # characters; longer ones are not kept
_MASK = (1 << 64) - 1
_hash = xxhash.xxh3_64_intdigest


def _slot(h: int, seed: int, n: int) -> int:
    x = (h ^ (seed * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """Maps each of n byte strings to its own slot of n; get() gives the value, or None for any other string.

    Keys fall into buckets of about two; from the largest bucket on, a seed is sought that sends the whole bucket to free
    slots. Buckets of one key take the free slots that remain, so the table has no empty slot.
    """

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = len(ranks)
        self.buckets = max(1, n // 2)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        keys = list(ranks)
        hashes = [_hash(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        free = None
        for b in order:
            members = groups[b]
            if not members:
                break
            if len(members) == 1:
                free = free or iter([s for s in range(n) if self.keys[s] is None])
                slots = [next(free)]
                self.seeds[b] = -slots[0] - 1
            else:
                seed = 0
                while True:
                    seed += 1
                    slots = [_slot(hashes[i], seed, n) for i in members]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                self.seeds[b] = seed
            for i, s in zip(members, slots):
                self.keys[s], self.values[s] = keys[i], ranks[keys[i]]

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = _hash(key)
        seed = self.seeds[h % self.buckets]
        s = -seed - 1 if seed < 0 else _slot(h, seed, self.n)
        return self.values[s] if self.keys[s] == key else None


def merge(piece: bytes, rank) -> list[int]:
    """Ids of a pre-token: the lowest-ranked adjacent pair is joined first, the leftmost among equals.

    A part is known by its first byte's place; end[a] is where it ends and the next begins, before[a] where the last began,
    ids[a] its id once joined. A heap entry is one integer: rank, place and stop, each of as many bits as the length has.
    """
    n = len(piece)
    bits = n.bit_length()
    ones = (1 << bits) - 1
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    ids = [-1] * n
    heap = [(r << bits | a) << bits | a + 2 for a in range(n - 1) if (r := rank(piece[a:a + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        stop, a = entry & ones, entry >> bits & ones
        b = end[a]
        if b < 0 or b >= n or end[b] != stop:  # one of the two has changed since
            continue
        end[a], end[b], ids[a] = stop, -1, entry >> 2 * bits
        if stop < n:
            before[stop] = a
            if (r := rank(piece[a:end[stop]])) is not None:
                heapq.heappush(heap, (r << bits | a) << bits | end[stop])
        left = before[a]
        if left >= 0 and (r := rank(piece[left:stop])) is not None:
            heapq.heappush(heap, (r << bits | left) << bits | stop)
    out, at = [], 0
    while at < n:
        out.append(ids[at] if ids[at] >= 0 else rank(piece[at:at + 1]))
        at = end[at]
    return out


class Recent(dict):
    """Ids (packed int32) of pre-tokens by their text, in two generations: a full one becomes the old one, and what is used again moves back.

    A generation is full when its entries take half of `limit` bytes."""

    def __init__(self, find, limit: int = CACHE_BYTES):
        self.find, self.old, self.limit, self.room = find, {}, limit, limit // 2

    def __missing__(self, token: str) -> bytes:
        ids = self.old.get(token)
        if ids is None:
            ids = self.find(token.encode("utf-8"))
        if len(token) <= LONG_PRETOKEN:
            if self.room <= 0:
                self.old = dict(self)
                self.clear()
                self.room = self.limit // 2
            self[token] = ids
            self.room -= len(token) + len(ids) + ENTRY_BYTES
        return ids


class Codec:
    """Encoder and decoder over one vocabulary; small enough to be broadcast (bounded by MAX_VOCABULARY entries)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"the vocabulary has {len(ranks)} entries, over {MAX_VOCABULARY}")
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes, such as {missing[0]}")
        self.table = PerfectHash(ranks)
        self.pattern = pattern
        self.ranks = ranks
        self.recent: Recent | None = None  # made in the worker process, where it stays from task to task
        self.bytes_of = pa.nulls(0, pa.binary())
        if ranks:
            of = {rank: key for key, rank in ranks.items()}
            self.bytes_of = pa.array([of.get(rank) for rank in range(max(of) + 1)], pa.binary())

    def ids_of(self, raw: bytes) -> bytes:
        """Ids of one pre-token, packed."""
        whole = self.table.get(raw)
        return array("i", [whole] if whole is not None else merge(raw, self.ranks.get)).tobytes()

    def packer(self, cache_bytes: int = CACHE_BYTES):
        """A function from a text to its ids, packed as int32."""
        find = regex.compile(self.pattern).findall
        if self.recent is None or self.recent.limit != cache_bytes:
            self.recent = Recent(self.ids_of, cache_bytes)
        ids = self.recent.__getitem__
        return lambda text: b"".join(map(ids, find(text))) if text else b""

    def encoder(self):
        """A function from a text to the list of its ids."""
        pack = self.packer()
        return lambda text: np.frombuffer(pack(text), np.int32).tolist()

    def decode(self, ids) -> bytes:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_lists(self, lists: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list of ids: the entries of all ids side by side, cut where a list ends."""
        parts = self.bytes_of.take(lists.flatten())
        if parts.null_count:
            raise ValueError("an id is not in the vocabulary")
        lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        _, offsets, data = parts.buffers()
        starts = np.frombuffer(offsets, np.int32)[parts.offset:parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int32)
        cuts = starts[np.concatenate(([0], np.cumsum(lengths)))]
        missing = pc.is_valid(lists).cast(pa.uint8()).to_numpy(zero_copy_only=False)
        valid = pa.py_buffer(np.packbits(missing, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(lists), [valid, pa.py_buffer(cuts.astype(np.int32).tobytes()), data if data is not None else pa.py_buffer(b"")])


def load_codec(spark: SparkSession, path: str, pattern: str) -> Codec:
    """A file of lines `base64 rank`."""
    lines = [row[0].split() for row in spark.read.text(path).limit(MAX_VOCABULARY + 1).collect() if row[0].strip()]
    return Codec({base64.b64decode(key): int(rank) for key, rank in lines}, pattern)


def encode(docs: DataFrame, codec: Codec, text: str = "text", out: str = "ids", decoded: str | None = None, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """The rows with a column of token ids (array<int>); special tokens are ordinary text. With `decoded`, also the bytes of
    those ids, decoded by the same worker."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    made = [out, decoded] if decoded else [out]
    rest = [c for c in docs.columns if c not in made]
    keep = [docs[f"`{c}`"] for c in rest]
    own = free_name(docs.columns, "_text")
    source = docs.select(*keep, docs[f"`{text}`"].alias(own))
    schema = T.StructType([*source.select(*(f"`{c}`" for c in rest)).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.BinaryType(), True)] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        one = codec.packer(cache_bytes)
        for batch in pieces(batches, own):
            lists = [one(t) for t in batch.column(own).to_pylist()]
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]) // 4, pa.int32()), pa.array(np.frombuffer(b"".join(lists), np.int32)))
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, ids, *([codec.decode_lists(ids)] if decoded else [])], names=[*rest, *made])

    return source.mapInArrow(lean(run), schema)


def decode(docs: DataFrame, codec: Codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    rest = [c for c in docs.columns if c != out]
    own = free_name(docs.columns, "_ids")
    source = docs.select(*(docs[f"`{c}`"] for c in rest), docs[f"`{ids}`"].alias(own))
    schema = T.StructType([*source.select(*(f"`{c}`" for c in rest)).schema.fields, T.StructField(out, T.BinaryType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in pieces(batches, own, measure=pc.list_value_length):
            raw = codec.decode_lists(batch.column(own))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), raw], names=[*rest, out])

    return source.mapInArrow(lean(run), schema)


def token_digests(encoded: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents (doc_id, ids); their bytes are decoded here unless a column `decoded` has them."""
    both = encoded if "decoded" in encoded.columns else decode(encoded.select("doc_id", "ids"), codec)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
