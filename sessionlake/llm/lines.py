"""Line de-duplication by a deletion-neighbourhood join: the earliest of lines within one word edit stays.

A line is the text between line feeds; its words (A-Z lower-cased, white space ignored) are what is compared. Two lines are near when
their word sequences are equal, or when both have MIN_WORDS words or more and differ by at most one word inserted, deleted
or replaced. A line is dropped when a near line comes earlier, in the order of doc_id, hash of the text, line number,
whether or not that line is itself dropped. Blank lines stay.

1. Every document's lines become rows of hashes. Equal lines are one from here on, known by the earliest.
2. Lines within one edit agree in the first or the second half of the longer one, so a line that shares neither half with
   another needs no variants. This exact sieve removes most lines before anything is multiplied.
3. What is left is read again. Each line emits hashed variants with one word left out (of the half that is not shared): keyed with the place
   for replacements, without it for deletions, which meet the whole lines of one word less.
4. Equal variants are joined to the earliest line of their key, never to each other, so a crowd of n lines gives n pairs.
   Word sequences of both ends are compared before a line is dropped.

Variants grow with the length of a line, not with the number of its partners; hot keys are reduced by partial aggregates and
joined by a join that can split them.

Defined cases: null and empty texts have no lines; rows of equal doc_id and text are one document (both keep the same
lines); a null doc_id comes last; other columns pass through dedup_lines, which rewrites text and n_chars and removes a
document that loses all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import bucket_count, by_bucket, free_name, lean, pieces
from sessionlake.llm.words import _BASE, _INVERSE, mix, powers, words
from sessionlake.session import cut_lineage

MIN_WORDS = 8
BUCKET_BYTES = 16 << 20  # of text for each bucket of the sieve


class Lines:
    """Lines with words of a column of texts: text and number of each, its words, and hashes of any stretch of words."""

    def __init__(self, column):
        w = self.words = words(column)
        breaks = np.concatenate(([0], np.cumsum(w.buffer == 10, dtype=np.int64)))
        text_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        number = breaks[w.starts] - breaks[w.offsets[:-1]][text_of]
        fresh = np.ones(len(number), dtype=bool)
        fresh[1:] = (number[1:] != number[:-1]) | (text_of[1:] != text_of[:-1])
        self.start = np.flatnonzero(fresh)
        self.end = np.concatenate((self.start[1:], [len(number)])) if len(number) else self.start
        self.text, self.number = text_of[self.start], number[self.start]
        self.bounds = np.searchsorted(self.text, np.arange(len(w.first)))
        up = powers(_BASE, len(w.hashes))
        self.down = powers(_INVERSE, len(w.hashes) + 1)
        self.sums = np.zeros(len(w.hashes) + 1, dtype=np.uint64)
        np.cumsum(w.hashes * up, out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words start..end as if they stood first in a line."""
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _tagged(h: np.ndarray, tag: np.ndarray, kind: int) -> np.ndarray:
    return mix(mix(h) + tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind)).view(np.int64)


def _source(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(docs[f"`{id_column}`"].alias("d"), F.xxhash64(docs[f"`{text}`"]).alias("t"), docs[f"`{text}`"].alias("text"))


def line_table(source: DataFrame) -> DataFrame:
    """d, t (hash of the text), and of its lines with words: i (numbers), h (hashes)."""
    kind = source.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = Lines(batch.column("text"))
            bounds = pa.array(x.bounds, pa.int32())
            h = _tagged(x.stretch(x.start, x.end), x.end - x.start, 1)
            yield pa.record_batch({"d": batch.column("d"), "t": batch.column("t"), "i": pa.ListArray.from_arrays(bounds, pa.array(x.number, pa.int32())), "h": pa.ListArray.from_arrays(bounds, pa.array(h))})

    return source.mapInArrow(lean(run), f"d {kind}, t long, i array<int>, h array<long>")


def shared_halves(source: DataFrame, buckets: int) -> DataFrame:
    """h, low, high, whole of lines that share a half with another line.

    low: the second half is shared, so the edit may lie in the first; high: the first half is shared; whole: a half of a line
    one word longer is shared. Keys travel as packed arrays by bucket, each key of a batch once for each line.
    """
    bits = np.uint64(64 - 32 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = Lines(batch.column("text"))
            h = _tagged(x.stretch(x.start, x.end), x.end - x.start, 1)
            _, first = np.unique(h, return_index=True)
            first = first[(x.end - x.start)[first] >= MIN_WORDS]
            s, e, h = x.start[first], x.end[first], h[first]
            m = e - s
            keys = np.concatenate((_tagged(x.stretch(s, s + m // 2), m, 2), _tagged(x.stretch(s + m // 2, e), m, 3),
                                   _tagged(x.stretch(s, s + (m + 1) // 2), m + 1, 2), _tagged(x.stretch(e - (m + 1 - (m + 1) // 2), e), m + 1, 3))).view(np.uint64) >> bits
            side, owner = np.repeat(np.arange(4, dtype=np.uint8), len(h)), np.tile(h, 4)
            rows = [(b, keys[at].astype("<u4").tobytes(), owner[at].tobytes(), side[at].tobytes()) for b, at in by_bucket((keys >> np.uint64(32)).astype(np.int64), buckets)]
            if rows:
                b, keys_, owners, sides = zip(*rows)
                yield pa.record_batch({"bucket": pa.array(b, pa.int32()), "keys": pa.array(keys_, pa.binary()), "owners": pa.array(owners, pa.binary()), "sides": pa.array(sides, pa.binary())})

    def meet(rows: pa.Table) -> pa.Table:
        keys, owners, sides = (np.concatenate([np.frombuffer(v.as_py(), kind) for v in rows.column(c)]) for c, kind in (("keys", "<u4"), ("owners", np.int64), ("sides", np.uint8)))
        order = np.lexsort((owners, keys))
        keys, owners, sides = keys[order], owners[order], sides[order]
        same = keys[1:] == keys[:-1]
        other = same & (owners[1:] != owners[:-1])
        key = np.concatenate(([0], np.cumsum(~same)))
        crowded = np.bincount(key[1:][other], minlength=key[-1] + 1) > 0
        stay = crowded[key]
        return pa.table({"h": pa.array(owners[stay]), "side": pa.array(sides[stay], pa.int32())})

    met = source.select("text").mapInArrow(lean(run), "bucket int, keys binary, owners binary, sides binary").groupBy("bucket").applyInArrow(meet, "h long, side int")
    flag = lambda condition, name: F.max(condition.cast("int")).alias(name)
    return met.groupBy("h").agg(flag(F.col("side") == 1, "low"), flag(F.col("side") == 0, "high"), flag(F.col("side") >= 2, "whole"))


def _order(*columns: str) -> Column:
    """Comparable place of a line: nulls last, then doc_id, text hash, line number."""
    return F.struct(F.col("d").isNull().alias("z"), *(F.col(c) for c in columns))


def _variants(texts: DataFrame, buckets: int) -> DataFrame:
    """Of rows (d, t, text, wanted: array<struct<i, h, low, high, whole>>): rows of lines (d, t, i, h, words), and rows of packed
    variants (bucket, keys, owners, roles: 0 a word replaced, 1 the whole line, 2 a word left out).

    Keys are whole hashes: only the earliest line of a key is tried, so a stranger that met on a part of it would hide a neighbour.
    """
    kind = texts.schema["d"].dataType.simpleString()
    bits = np.uint64(32 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = Lines(batch.column("text"))
            own = {(int(t), int(i)): k for k, (t, i) in enumerate(zip(x.text, x.number))}
            lines, variants, roles = [], [], []
            for r, wanted in enumerate(batch.column("wanted").to_pylist()):
                for line in wanted:
                    k = own[r, line["i"]]
                    s, e = int(x.start[k]), int(x.end[k])
                    n = e - s
                    at = np.concatenate((np.arange(s, s + n // 2) if line["low"] else np.zeros(0, np.int64), np.arange(s + n // 2, e) if line["high"] else np.zeros(0, np.int64)))
                    # Words before the place, and those after it moved one to the left.
                    rest = (x.sums[at] - x.sums[s]) * x.down[s] + (x.sums[e] - x.sums[at + 1]) * x.down[s + 1]
                    left_out = np.unique(_tagged(rest, np.full(len(at), n - 1), 5))
                    replaced = _tagged(mix(rest) + (at - s).astype(np.uint64), np.full(len(at), n), 4)
                    whole = _tagged(x.stretch(np.array([s]), np.array([e])), np.array([n]), 5) if line["whole"] else left_out[:0]
                    variants.append(np.concatenate((replaced, whole, left_out)))
                    roles.append(np.repeat(np.array([0, 1, 2], np.uint8), (len(replaced), len(whole), len(left_out))))
                    lines.append((r, line["i"], line["h"], x.words.hashes[s:e].view(np.int64)))
            if not lines:
                continue
            keys, role = np.concatenate(variants).view(np.uint64), np.concatenate(roles)
            owner = np.repeat(np.array([line[2] for line in lines], np.int64), [len(v) for v in variants])
            rows = [(b, keys[at].astype("<u8").tobytes(), owner[at].tobytes(), role[at].tobytes()) for b, at in by_bucket((keys >> bits >> np.uint64(32)).astype(np.int64), buckets)]
            pick, more, blank = pa.array([line[0] for line in lines], pa.int64()), len(rows), len(lines)
            sequence = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(line[3]) for line in lines)]), pa.int32()), pa.array(np.concatenate([line[3] for line in lines])))
            columns = {"d": batch.column("d").take(pick), "t": batch.column("t").take(pick), "i": pa.array([line[1] for line in lines], pa.int32()), "h": pa.array([line[2] for line in lines], pa.int64()), "words": sequence}
            out = {name: pa.concat_arrays([value, pa.nulls(more, value.type)]) for name, value in columns.items()}
            for at, (name, type_) in enumerate((("bucket", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("roles", pa.binary()))):
                out[name] = pa.array([None] * blank + [row[at] for row in rows], type_)
            yield pa.record_batch(out)

    return texts.mapInArrow(lean(run), f"d {kind}, t long, i int, h long, words array<long>, bucket int, keys binary, owners binary, roles binary")


def _met(rows: pa.Table) -> pa.Table:
    """key, role, h of variants whose key another line has, too."""
    keys, owners, roles = (np.concatenate([np.frombuffer(v.as_py(), kind) for v in rows.column(c)]) for c, kind in (("keys", "<u8"), ("owners", np.int64), ("roles", np.uint8)))
    order = np.lexsort((owners, keys))
    keys, owners, roles = keys[order], owners[order], roles[order]
    same = keys[1:] == keys[:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    stay = (np.bincount(group[1:][same & (owners[1:] != owners[:-1])], minlength=group[-1] + 1) > 0)[group]
    return pa.table({"key": pa.array(keys[stay].view(np.int64)), "role": pa.array(roles[stay], pa.int32()), "h": pa.array(owners[stay])})


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays differ by at most one element inserted, deleted or replaced."""
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n = F.size(short)
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | (F.get(short, i) != F.get(long_, i)))
    first = F.get(differ, F.lit(0))
    replaced = (F.size(a) == F.size(b)) & (F.slice(a, first + 2, n) == F.slice(b, first + 2, n))
    left_out = (F.size(long_) == n + 1) & (F.slice(short, first + 1, n + 1) == F.slice(long_, first + 2, n + 1))
    return replaced | left_out


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """d, t, n_lines, dropped (sorted array of line numbers): one row for each distinct pair of id and text."""
    source = _source(docs, id_column, text)
    table = cut_lineage(line_table(source))
    lines = table.select("d", "t", F.explode(F.arrays_zip("i", "h")).alias("x")).select("d", "t", "x.i", "x.h")
    firsts = cut_lineage(lines.groupBy("h").agg(F.min(_order("d", "t", "i")).alias("first"), F.count("*").alias("copies")))

    buckets = bucket_count(docs, text, BUCKET_BYTES)
    sides = shared_halves(source, buckets)
    left = firsts.select("h", "first.*").join(sides, "h").groupBy("d", "t").agg(F.collect_list(F.struct("i", "h", "low", "high", "whole")).alias("wanted"))
    left = left.select(F.col("d").alias("e"), F.col("t").alias("u"), "wanted")
    texts = source.join(left, F.col("e").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u"))).select("d", "t", "text", "wanted")
    table_ = cut_lineage(_variants(texts, buckets))
    near = table_.filter("bucket is null").select("d", "t", "i", "h", "words").dropDuplicates(["h"])
    met = table_.filter("bucket is not null").select("bucket", "keys", "owners", "roles").groupBy("bucket").applyInArrow(_met, "key long, role int, h long").distinct()
    rows = cut_lineage(met.join(near.select("d", "t", "i", "h"), "h"))
    place = _order("d", "t", "i", "h")
    least = rows.groupBy("key").agg(F.min(F.when(F.col("role") == 0, place)).alias("r0"), F.min(F.when(F.col("role") == 1, place)).alias("r1"), F.min(F.when(F.col("role") == 2, place)).alias("r2"), F.count("*").alias("many")).filter("many > 1")
    partner = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    pairs = rows.join(least, "key").withColumn("partner", partner).filter(F.col("partner") < place).select("h", F.col("partner.h").alias("p")).distinct()
    sequences = near.select("h", "words")
    verified = pairs.join(sequences, "h").join(sequences.select(F.col("h").alias("p"), F.col("words").alias("other")), "p").filter(within_one(F.col("words"), F.col("other")))
    fuzzy = cut_lineage(verified.select("h").distinct().withColumn("fuzzy", F.lit(True)))

    # Only lines that occur again or have an earlier near line can go.
    doubtful = firsts.join(fuzzy, "h", "left").filter("copies > 1 or fuzzy").select("h", "first", F.coalesce("fuzzy", F.lit(False)).alias("fuzzy"))
    gone = lines.select("d", "t", "i", "h").join(doubtful, "h").filter(F.col("fuzzy") | (_order("d", "t", "i") > F.col("first"))).select("d", "t", "i").distinct()
    per = gone.groupBy(F.col("d").alias("gd"), F.col("t").alias("gt")).agg(F.array_sort(F.collect_list("i")).alias("dropped"))
    documents = table.select("d", "t", F.size("i").alias("n_lines")).dropDuplicates(["d", "t"])
    return documents.join(per, F.col("d").eqNullSafe(F.col("gd")) & (F.col("t") == F.col("gt")), "left").select("d", "t", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped: one row per document."""
    found = dropped_lines(docs)
    ids = docs.select("doc_id", F.xxhash64("text").alias("u"))
    return (ids.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("u") == F.col("t")))
            .select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped")))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents without dropped lines, in their own columns."""
    found = dropped_lines(docs, id_column, text).filter(F.size("dropped") > 0)
    columns = docs.columns
    d, t, u, dropped, all_ = (free_name(columns, wanted) for wanted in ("_d", "_t", "_u", "_dropped", "_all"))
    gone = found.select(F.col("d").alias(d), F.col("t").alias(t), F.col("dropped").alias(dropped), (F.size("dropped") == F.col("n_lines")).alias(all_))
    marked = docs.withColumn(u, F.xxhash64(docs[f"`{text}`"]))
    joined = marked.join(gone, marked[f"`{id_column}`"].eqNullSafe(gone[d]) & (marked[u] == gone[t]), "left").filter(~F.coalesce(F.col(all_), F.lit(False)))
    joined = joined.select(*(f"`{c}`" for c in docs.columns), dropped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            at, gone_ = batch.schema.get_field_index(text), batch.column(dropped)
            if gone_.null_count < len(batch):
                texts = batch.column(at).to_pylist()
                for r, numbers in enumerate(gone_.to_pylist()):
                    if numbers:
                        out = set(numbers)
                        texts[r] = "\n".join(line for i, line in enumerate(texts[r].split("\n")) if i not in out)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select(columns)

    out = joined.mapInArrow(lean(run), T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))
    if length in docs.columns:
        kind = docs.schema[length].dataType
        changed = F.length(F.col(f"`{text}`")).cast(kind)
        out = out.withColumn(length, F.when(F.col(f"`{text}`").isNull(), F.col(f"`{length}`")).otherwise(changed))
    return out.select(*(f"`{c}`" for c in docs.columns))
