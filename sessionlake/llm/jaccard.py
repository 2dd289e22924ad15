"""Near-duplicate texts by an exact Jaccard join of word shingles with token-combination prefixes.

Sets are the distinct five-word shingles of a text (as 64-bit hashes); sets link when 100 * intersection >= 75 * union. Equal sets are
one node from the start.

1. Count shingles over all documents and call those in more than FREQUENT sets frequent. The list is only an ordering: any
   list gives the same links. At most MAX_FREQUENT, the most frequent ones, are used, so the broadcast is bounded.
2. Every set is ordered rare shingles first, then by hash. Two linked sets share a shingle in their prefixes of
   n - ceil(0.75 n) + 1. Rare prefix shingles are index keys by themselves.
3. A set whose prefix reaches frequent shingles is extended by m places, where m depends on the size class of the smaller set. Linked sets then share
   m + 1 shingles of the extended prefixes: a rare one, which is a key, or m + 1 frequent ones, of which two fall in the same
   of m hash classes. So pairs of frequent shingles of one class are keys: about two for each place, not all combinations.
4. Sets that share a key make pairs, if their sizes allow a link and bit signatures (which bound the intersection from
   above) do not rule it out. Keys of over FREQUENT sets make no pairs: their sets are chained, within a batch before the shuffle and across batches after it, so a
   key that a third of all documents share costs its batches, not its rows. Pairs and chains form candidate groups; linked sets never lie in two.
5. Candidate groups are verified exactly: small ones whole, several in a task; large ones by pairs of blocks of
   compatible sizes. Only pairs not yet connected are intersected.

Defined cases: texts without words have an empty set and are linked with nothing; fewer than five words are one shingle; rows of one id and
text are linked; a null id is never the smallest of a group unless all are null; other columns pass through keep_one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlake.llm.common import bucket_count, by_bucket, free_name, lean, pieces, smallest_linked
from sessionlake.llm.words import distinct_sets, mix, shingles, words
from sessionlake.session import cut_lineage

SHINGLE = 5
PERCENT = 75
FREQUENT = 16
MAX_FREQUENT = 4_000_000
BUCKET_BYTES = 8 << 20  # of text for each bucket of the index
WHOLE_GROUP = 1024  # sets verified together in one task; larger groups go by blocks of this size
_HALF = np.uint64(1 << 63)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-PERCENT * n // 100) + 1


def _class(n: int) -> int:
    """Size class: sizes of linked sets lie in one class or in neighbouring ones."""
    g = int(math.log(n) / math.log(100 / PERCENT))
    while (100 / PERCENT) ** (g + 1) <= n * (1 + 1e-12):
        g += 1
    return g


def _extension(g: int) -> int:
    least = max(3, math.ceil((100 / PERCENT) ** max(g, 0) - 1e-9))
    return max(1, int(prefix_length(np.array([least]))[0]) // 3)


def _sets(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, their bounds, and a hash of the whole set."""
    h, bounds = distinct_sets(*shingles(words(column), SHINGLE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return h, bounds, mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def frequent_shingles(docs: DataFrame, buckets: int, text: str = "text") -> np.ndarray:
    """Sorted ends (32 bits and the bucket's) of shingles in more than FREQUENT sets, counted over all documents.

    Only the lower half of the hash order is counted: prefixes are the lowest quarter, and what they skip is rarely more than
    another quarter. Shingles beyond count as rare, which costs time where they are not, but no link.
    """
    shift = np.uint64(32 - (buckets.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            h, _, _ = _sets(batch.column(text))
            token, times = np.unique(mix(h[h < _HALF]) >> shift, return_counts=True)
            rows = []
            for b, places in by_bucket((token >> np.uint64(32)).astype(np.int64), buckets):
                many = times[places] > 1
                rows.append((b, token[places].astype("<u4").tobytes(), np.flatnonzero(many).astype("<u4").tobytes(), times[places][many].astype("<u4").tobytes()))
            if rows:
                b, tokens, places, more = zip(*rows)
                yield pa.record_batch({"bucket": pa.array(b, pa.int32()), "tokens": pa.array(tokens, pa.binary()), "places": pa.array(places, pa.binary()), "times": pa.array(more, pa.binary())})

    def merge(rows: pa.Table) -> pa.Table:
        tokens, times = [], []
        for r in range(len(rows)):
            tokens.append(np.frombuffer(rows.column("tokens")[r].as_py(), "<u4"))
            times.append(np.ones(len(tokens[-1]), np.int64))
            times[-1][np.frombuffer(rows.column("places")[r].as_py(), "<u4")] = np.frombuffer(rows.column("times")[r].as_py(), "<u4")
        token, n = np.concatenate(tokens), np.concatenate(times)
        order = np.argsort(token)
        token, n = token[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        total = np.add.reduceat(n, first)
        keep = total > FREQUENT
        whole = token[first][keep].astype(np.int64) + (rows.column("bucket")[0].as_py() << 32)
        return pa.table({"token": pa.array(whole), "n": pa.array(total[keep])})

    counted = docs.select(text).mapInArrow(lean(count), "bucket int, tokens binary, places binary, times binary")
    found = cut_lineage(counted.groupBy("bucket").applyInArrow(merge, "token long, n long"))
    if found.count() > MAX_FREQUENT:
        found = found.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT)
    return np.sort(found.select("token").toArrow().column(0).to_numpy().astype(np.uint64))


def index_keys(h: np.ndarray, bounds: np.ndarray, frequent: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every set, and the number of the set each belongs to."""
    n = np.diff(bounds)
    set_of = np.repeat(np.arange(len(n)), n)
    tail = mix(h) >> np.uint64(32 - (buckets.bit_length() - 1))
    common = np.zeros(len(h), dtype=bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tail), len(frequent) - 1)
        common = (frequent[at] == tail) & (h < _HALF)
    mixed = np.flatnonzero(np.bincount(set_of[common], minlength=len(n)))
    pure = np.ones(len(n), dtype=bool)
    pure[mixed] = False
    rank = np.arange(len(h)) - bounds[:-1][set_of]
    chosen = np.flatnonzero(pure[set_of] & (n[set_of] > 2) & (rank < prefix_length(n)[set_of]))
    keys, owners = [mix(h[chosen])], [set_of[chosen]]
    for i in mixed.tolist():
        size = int(n[i])
        if size < 3:  # smaller sets link to equal ones only
            continue
        own, flags = h[bounds[i]:bounds[i + 1]], common[bounds[i]:bounds[i + 1]]
        rare, often = own[~flags], own[flags]
        p = int(prefix_length(np.array([size]))[0])
        if len(rare) >= p:
            keys.append(mix(rare[:p]))
            owners.append(np.full(p, i))
            continue
        g = _class(size)
        reach = 0
        for tag in (g, g - 1):
            m = _extension(tag)
            reach = max(reach, p + m)
            part = often[:max(0, p + m - len(rare))]
            group = (mix(part ^ np.uint64(0xABCDEF12345)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            part, group = part[order], group[order]
            shift = 1
            while shift < len(part):
                same = np.flatnonzero(group[shift:] == group[:-shift])
                if not len(same):
                    break
                low, high = np.minimum(part[same], part[same + shift]), np.maximum(part[same], part[same + shift])
                keys.append(mix(mix(low + np.uint64(tag + 2)) ^ high))
                owners.append(np.full(len(same), i))
                shift += 1
        keys.append(mix(rare[:reach]))
        owners.append(np.full(len(rare[:reach]), i))
    return np.concatenate(keys), np.concatenate(owners)


MANY = 65535
_REACH = math.ceil(2000 * math.log2(100 / PERCENT)) + 2


def _grade(n: np.ndarray) -> np.ndarray:
    return np.floor(2000 * np.log2(np.maximum(n, 1))).astype(np.int64)


def _crowds(keys: np.ndarray, limit: int, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the place of each key's first entry, and whether over `limit` entries share it (or one stands for many)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    group = np.cumsum(first) - 1
    lead = np.flatnonzero(first)[group]
    crowded = np.bincount(group) > limit
    if many is not None:
        crowded |= np.bincount(group, weights=many) > 0
    return lead, crowded[group]


def _chain(sids: np.ndarray, lead: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links of the sets of crowded keys to their key's first set."""
    at = np.flatnonzero(crowded & (sids != sids[lead])) if len(sids) else np.zeros(0, np.int64)
    pair = np.unique(np.stack((sids[lead[at]], sids[at]), axis=1), axis=0)
    return pair[:, 0], pair[:, 1]


def _bits(h: np.ndarray) -> bytes:
    """A power of two of bits, at least four for each element; element x sets the bit of its low bits."""
    size = 64
    while size < 4 * len(h):
        size *= 2
    out = np.zeros(size, dtype=bool)
    out[(mix(h) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def may_link(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> bool:
    """False only if two sets can't link: elements whose bit the other set lacks are not shared."""
    a, b = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] | a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] | b[len(b) // 2:]
    most = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return 100 * most >= PERCENT * (n_a + n_b - most)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")))
        keep = pa.array([may_link(*row) for row in rows], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def _documents(docs: DataFrame) -> DataFrame:
    """d, t, sid (hash of the set), n (its size), bits (the set hashed to at least 4 n bits)."""
    kind = docs.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            h, bounds, sid = _sets(batch.column("text"))
            bits = [_bits(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.record_batch({"d": batch.column("d"), "t": batch.column("t"), "sid": pa.array(sid.view(np.int64)), "n": pa.array(np.diff(bounds), pa.int64()), "bits": pa.array(bits, pa.binary())})

    return docs.mapInArrow(lean(run), f"d {kind}, t long, sid long, n long, bits binary")


def _candidates(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """a, b, sure: pairs of sets that share a rare key and have compatible sizes; links (sure) that chain the sets of a crowded key.

    Keys travel as packed arrays by bucket: 32 bits of the key, the set, its size on a fine logarithmic scale. A key that more than FREQUENT
    sets of one batch share is chained there, and only its lowest set goes on, marked as one of many.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    shift = np.uint64(32 - (buckets.bit_length() - 1))
    names = ("keys", "sids", "sizes", "a", "b")
    kinds = ("<u4", np.uint64, "<u2", np.int64, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            h, bounds, sid = _sets(batch.column("text"))
            _, first = np.unique(sid, return_index=True)
            copy = np.ones(len(sid), dtype=bool)
            copy[first] = False
            keys, owners = index_keys(h, bounds, shared.value, buckets)
            stay = ~copy[owners]
            keys, sids, grade = keys[stay] >> shift, sid[owners[stay]], _grade(np.diff(bounds)[owners[stay]])
            order = np.lexsort((sids, keys))
            keys, sids, grade = keys[order], sids[order], grade[order]
            fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1]))) if len(keys) else np.zeros(0, bool)
            keys, sids, grade = keys[fresh], sids[fresh], grade[fresh]
            lead, crowded = _crowds(keys, FREQUENT)
            a, b = _chain(sids, lead, crowded)
            grade = np.where(crowded, MANY, grade)
            stay = ~crowded | (np.arange(len(keys)) == lead)
            keys, sids, grade = keys[stay], sids[stay], grade[stay]
            none = b""
            rows = [(bucket, keys[at].astype("<u4").tobytes(), sids[at].tobytes(), grade[at].astype("<u2").tobytes(), none, none) for bucket, at in by_bucket((keys >> np.uint64(32)).astype(np.int64), buckets)]
            rows += [(bucket, none, none, none, a[at].tobytes(), b[at].tobytes()) for bucket, at in by_bucket((a % np.uint64(buckets)).astype(np.int64), buckets)]
            if rows:
                columns = list(zip(*rows))
                yield pa.record_batch({"bucket": pa.array(columns[0], pa.int32()), **{name: pa.array(column, pa.binary()) for name, column in zip(names, columns[1:])}})

    def meet(rows: pa.Table) -> pa.Table:
        keys, sids, grade, a, b = (np.concatenate([np.frombuffer(v.as_py(), kind) for v in rows.column(c)]) for c, kind in zip(names, kinds))
        order = np.lexsort((sids, keys))
        keys, sids, grade = keys[order], sids[order], grade[order].astype(np.int64)
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1]) | (grade[1:] != grade[:-1]))) if len(keys) else np.zeros(0, bool)
        keys, sids, grade = keys[fresh], sids[fresh], grade[fresh]
        lead, crowded = _crowds(keys, FREQUENT, grade == MANY)
        x, y = _chain(sids, lead, crowded)
        a, b = np.concatenate((a, x.view(np.int64))), np.concatenate((b, y.view(np.int64)))
        pairs = [np.zeros((0, 2), np.uint64)]
        for step in range(1, FREQUENT):
            at = np.flatnonzero((keys[step:] == keys[:-step]) & ~crowded[step:]) if len(keys) > step else np.zeros(0, np.int64)
            at = at[(np.abs(grade[at] - grade[at + step]) <= _REACH) & (sids[at] != sids[at + step])]
            pairs.append(np.stack((sids[at], sids[at + step]), axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0).view(np.int64)
        sure = np.concatenate((np.ones(len(a), bool), np.zeros(len(pairs), bool)))
        return pa.table({"a": pa.array(np.concatenate((a, pairs[:, 0]))), "b": pa.array(np.concatenate((b, pairs[:, 1]))), "sure": pa.array(sure)})

    return docs.select("text").mapInArrow(lean(run), "bucket int, keys binary, sids binary, sizes binary, a binary, b binary").groupBy("bucket").applyInArrow(meet, "a long, b long, sure boolean")


def _verified(sets: list[np.ndarray], left: range | list, right: range | list) -> list[tuple[int, int]]:
    """Links between sets of `left` and later sets of `right` that are needed to connect all linked ones."""
    root = list(range(len(sets)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    order = np.argsort(code, kind="stable")
    holder = np.repeat(np.arange(len(sets)), sizes)[order]
    places = np.searchsorted(code[order], np.arange(code.max() + 2)) if len(code) else np.zeros(1, np.int64)
    allowed = np.zeros(len(sets), dtype=bool)
    allowed[list(right)] = True
    out = []
    for i in left:
        own = code[cuts[i]:cuts[i + 1]]
        start, stop = places[own], places[own + 1]
        rows = np.repeat(start - np.concatenate(([0], np.cumsum(stop - start)[:-1])), stop - start) + np.arange((stop - start).sum())
        shared = np.bincount(holder[rows], minlength=len(sets))
        near = np.flatnonzero(allowed & (100 * shared >= PERCENT * (sizes[i] + sizes - shared)) & (np.arange(len(sets)) != i))
        for j in near.tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(d, t, sid, n) of the rows of docs (d, t, text), and (sid, root) of sets linked to others."""
    buckets = bucket_count(docs, "text", BUCKET_BYTES)
    info = cut_lineage(_documents(docs))
    pairs = cut_lineage(_candidates(docs, frequent_shingles(docs, buckets), buckets))
    known = info.filter("n > 0").select("sid", "n", "bits").dropDuplicates(["sid"])
    sized = pairs.filter("not sure").select("a", "b").distinct().join(known.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
    sized = sized.join(known.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
    possible = sized.filter(F.col("n_a") * 100 >= F.col("n_b") * PERCENT).filter(F.col("n_b") * 100 >= F.col("n_a") * PERCENT).select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(lean(_possible), "a long, b long")
    candidates = smallest_linked(possible.unionAll(pairs.filter("sure").select("a", "b")))
    counts = candidates.groupBy("root").agg(F.count("*").alias("members"))
    first = info.filter("n > 0").groupBy("sid").agg(F.min(F.struct(F.col("d").isNull().alias("z"), "d", "t")).alias("first"))
    wanted = candidates.join(counts, "root").join(first, F.col("node") == F.col("sid")).select("sid", "root", "members", F.col("first.d").alias("fd"), F.col("first.t").alias("ft"))
    texts = docs.join(wanted, F.col("d").eqNullSafe(F.col("fd")) & (F.col("t") == F.col("ft"))).select("sid", "root", "members", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            h, bounds, _ = _sets(batch.column("text"))
            blobs = [h[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.record_batch({"sid": batch.column("sid"), "root": batch.column("root"), "members": batch.column("members"), "n": pa.array(np.diff(bounds), pa.int64()), "items": pa.array(blobs, pa.binary())})

    table = cut_lineage(texts.mapInArrow(lean(sets), "sid long, root long, members long, n long, items binary"))

    def whole(rows: pa.Table) -> pa.Table:
        """Verify all groups of one bin."""
        out: list[tuple[int, int]] = []
        order = np.lexsort((rows.column("sid").to_numpy(), rows.column("root").to_numpy()))
        root, sid = rows.column("root").to_numpy()[order], rows.column("sid").to_numpy()[order]
        items = rows.column("items").combine_chunks()
        cuts = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1], [True])))
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            members = [np.frombuffer(items[int(k)].as_py(), np.uint64) for k in order[start:end]]
            out += [(int(sid[start + i]), int(sid[start + j])) for i, j in _verified(members, range(len(members)), range(len(members)))]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    small = table.filter(F.col("members") <= WHOLE_GROUP)
    bins = max(1, math.ceil(small.count() / WHOLE_GROUP))
    found = small.select("sid", "root", "items", F.pmod(F.xxhash64("root"), F.lit(bins)).alias("bin")).groupBy("bin").applyInArrow(whole, "a long, b long")

    # Large groups: blocks by size class and hash; a block meets itself and the blocks it may be linked with.
    large = table.filter(F.col("members") > WHOLE_GROUP)
    grade = F.floor(F.log("n") / math.log(100 / PERCENT) + 1e-9).cast("int")
    parts = large.groupBy("root", grade.alias("grade")).agg(F.ceil(F.count("*") / F.lit(WHOLE_GROUP)).cast("int").alias("parts"))
    dealt = large.withColumn("grade", grade).join(parts, ["root", "grade"]).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    blocks = cut_lineage(dealt.groupBy("root", "grade", "part").agg(F.collect_list(F.struct("sid", "items")).alias("members")))
    other = parts.select(F.col("root").alias("r"), F.col("grade").alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    meets = blocks.select("root", "grade", "part").join(other, (F.col("root") == F.col("r")) & F.col("g").isin(F.col("grade"), F.col("grade") + 1) & (
        (F.col("g") > F.col("grade")) | (F.col("p") >= F.col("part")))).select("root", "grade", "part", "g", "p")
    right = blocks.select(F.col("root").alias("r"), F.col("grade").alias("g"), F.col("part").alias("p"), F.col("members").alias("others"))
    work = blocks.join(meets, ["root", "grade", "part"]).join(right, (F.col("root") == F.col("r")) & meets["g"].eqNullSafe(right["g"]) & meets["p"].eqNullSafe(right["p"])).select("members", "others")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                one, two = ([(m["sid"], np.frombuffer(m["items"], np.uint64)) for m in batch.column(c)[r].as_py()] for c in ("members", "others"))
                ids = [s for s, _ in one] + [s for s, _ in two]
                same = {s for s, _ in one} & {s for s, _ in two}
                sets_ = [x for _, x in one] + ([] if same else [x for _, x in two])
                right_ = range(len(one)) if same else range(len(one), len(ids))
                out = [(ids[i], ids[j]) for i, j in _verified(sets_, range(len(one)), right_)]
                yield pa.record_batch({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    if not large.isEmpty():
        found = found.unionAll(work.mapInArrow(lean(across), "a long, b long"))
    return info, smallest_linked(found)


def _rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(docs[f"`{id_column}`"].alias("d"), F.xxhash64(docs[f"`{text}`"]).alias("t"), docs[f"`{text}`"].alias("text"))


def near_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """d, t, n_shingles, component_id, first (the place (z, d, t) of the group's first document): one row per document."""
    info, groups = _groups(_rows(docs, id_column, text))
    place = F.struct(F.col("d").isNull().alias("z"), "d", "t")
    classes = info.filter("n > 0").groupBy("sid").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    classes = classes.join(groups, classes.sid == groups.node, "left").withColumn("root", F.coalesce("root", "sid"))
    lowest = classes.groupBy("root").agg(F.min("first").alias("lowest"), F.sum("copies").alias("rows"))
    # Only sets with another document need to reach the rows.
    known = classes.join(lowest.filter("rows > 1"), "root").select(F.col("sid").alias("s"), "lowest")
    joined = info.join(known, F.when(F.col("n") > 0, F.col("sid")) == F.col("s"), "left").withColumn("first", F.coalesce("lowest", place))
    return joined.select("d", "t", F.col("n").alias("n_shingles"), F.col("first.d").alias("component_id"), "first")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that come first in their group, in their own columns. Of rows equal in id and text one stays, if they have words."""
    columns = docs.columns
    found = near_texts(docs, id_column, text)
    d, t, u, n, turn = (free_name(columns, c) for c in ("_d", "_t", "_u", "_n", "_turn"))
    stay = found.filter(F.col("d").eqNullSafe(F.col("first.d")) & (F.col("t") == F.col("first.t"))).groupBy("d", "t").agg(F.max("n_shingles").alias(n)).select(F.col("d").alias(d), F.col("t").alias(t), n)
    marked = docs.withColumn(u, F.xxhash64(docs[f"`{text}`"]))
    joined = marked.join(stay, marked[f"`{id_column}`"].eqNullSafe(stay[d]) & (marked[u] == stay[t]))
    joined = joined.withColumn(turn, F.row_number().over(Window.partitionBy(F.col(f"`{id_column}`"), u).orderBy(F.lit(0))))
    return joined.filter((F.col(turn) == 1) | (F.col(n) == 0)).select(*(f"`{c}`" for c in columns))


def jaccard_digests(found: DataFrame) -> DataFrame:
    return found.select(F.col("d").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")
