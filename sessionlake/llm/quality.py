"""Document quality by co-training: a text view and a page-metadata view label for each other, then vote with calibration.

Text view: shares of symbols, digits, capitals, separators and repeated words, word and sentence shape, and hashed words.
Metadata view: source, language, and layout (stored length, lines, bytes a character).

Fitting takes a bounded sample: rows whose id hash falls under a bound set so that about LABELLED_ROWS labelled and
UNLABELLED_ROWS unlabelled rows are read. A fifth of the labelled rows (by hash) is kept aside. In each of ROUNDS rounds both views are
fitted, and each adds its surest answers on unlabelled rows (SURE or more, in the proportion of the classes, at most ADDED of
them) to the other's training rows. The two scores are calibrated and combined by a logistic fit on the rows kept aside. The
threshold keeps at least KEEP_GOOD of the good rows there, and is no higher than 0.5.

Scoring covers every document in one pass without a shuffle.

Defined cases: null and empty texts have no words: score null, rejected; rows without id are scored but never used to fit; when labels of one
class are missing, nothing is fitted: scores are null and every document with words is kept; repeated labels of an id count by
their smallest; null metadata is a value of its own; missing metadata columns count as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import free_name, lean, pieces
from sessionlake.llm.words import mix, words

LABELLED_ROWS = 20_000
UNLABELLED_ROWS = 10_000
ROUNDS = 3
SURE = 0.98
ADDED = 1000
KEEP_GOOD = 0.998
WORD_BUCKETS = 32
SOURCE_BUCKETS, LANG_BUCKETS = 32, 16


def _shares(buffer: np.ndarray, offsets: np.ndarray, classes: list[np.ndarray]) -> np.ndarray:
    """For each text, the share of its bytes in each class."""
    sizes = np.maximum(np.diff(offsets), 1)
    out = []
    for members in classes:
        sums = np.concatenate(([0], np.cumsum(members[buffer], dtype=np.int64)))
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]) / sizes)
    return np.stack(out, axis=1) if len(sizes) else np.zeros((0, len(classes)))


def _bytes(*wanted) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for w in wanted:
        table[list(w)] = True
    return table


_CLASSES = [_bytes(b"#$%&*@^~<>{}[]\\=+_"), _bytes(b"|"), _bytes(range(48, 58)), _bytes(range(65, 91)), _bytes(range(128, 256)), _bytes(b".,;:!?"), _bytes(b"/"), _bytes(range(0, 9), range(14, 32))]


def _mean_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
    return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text view, metadata view and number of words of every row of (text, lang, source, n_chars)."""
    w = words(batch.column("text"))
    n = np.diff(w.first)
    text_of = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(w.hashes))
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text_of[1:] == text_of[:-1])
    key = np.sort((text_of.astype(np.uint64) << np.uint64(40)) | (w.hashes >> np.uint64(24)))
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    firsts = np.concatenate(([0], np.cumsum(fresh)))
    starts = np.flatnonzero(fresh)
    runs = np.diff(np.concatenate((starts, [len(key)])))
    bounds = firsts[w.first]
    top = np.zeros(len(n))
    np.maximum.at(top, np.repeat(np.arange(len(n)), np.diff(bounds)), runs)
    length = (w.ends - w.starts).astype(float)
    stop = _bytes(b".!?")[w.buffer[w.ends - 1]] if len(w.ends) else np.zeros(0, bool)
    symbol_word = np.zeros(0)
    if len(w.ends):
        sums = np.concatenate(([0], np.cumsum(_CLASSES[0][w.buffer], dtype=np.int64)))
        symbol_word = (sums[w.ends] - sums[w.starts]) > 0
    many = np.maximum(n, 1)
    buckets = np.bincount(text_of * WORD_BUCKETS + (w.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=len(n) * WORD_BUCKETS).reshape(len(n), WORD_BUCKETS) / many[:, None]
    text = np.column_stack((_shares(w.buffer, w.offsets, _CLASSES), np.log1p(n), np.diff(bounds) / many, top / many, _mean_by(same, w.first), _mean_by(length, w.first),
                            _mean_by(length > 12, w.first), _mean_by(length > 25, w.first), _mean_by(stop, w.first), _mean_by(symbol_word, w.first), buckets))

    def one_hot(name: str, size: int) -> np.ndarray:
        values = batch.column(name).cast(pa.string())
        codes = words(pa.array([f"_{v}".replace(" ", "_") for v in values.to_pylist()], pa.string())).hashes
        out = np.zeros((len(values), size))
        out[np.arange(len(values)), (mix(codes) % np.uint64(size)).astype(np.int64)] = 1
        return out

    breaks = _shares(w.buffer, w.offsets, [_bytes(b"\n")])[:, 0] * np.diff(w.offsets)
    stored = batch.column("n_chars").cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
    size = np.diff(w.offsets)
    meta = np.column_stack((np.log1p(np.maximum(stored, 0)), stored < 0, np.log1p(breaks), np.log1p(size / (breaks + 1)), size / np.maximum(stored, 1) if len(size) else size, one_hot("source", SOURCE_BUCKETS), one_hot("lang", LANG_BUCKETS)))
    return text, np.clip(meta, -50, 50), n


CHUNK_ROWS = 4096  # rows of a sample turned into doubles at once


def _chunks(rows: int) -> Iterator[slice]:
    return (slice(at, at + CHUNK_ROWS) for at in range(0, rows, CHUNK_ROWS))


class View(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        scores = [_standard(x[at], self.mean, self.scale) @ self.weights[1:] + self.weights[0] for at in _chunks(len(x))]
        return np.clip(np.concatenate(scores), -30, 30) if scores else np.zeros(0)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, prepare=lambda part: part) -> np.ndarray:
    """Newton's method with an L2 penalty; the first weight is the constant."""
    ridge = np.full(x.shape[1] + 1, penalty)
    ridge[0] = 1e-6
    w = np.zeros(len(ridge))
    for _ in range(25):
        curvature, gradient = np.diag(ridge), -ridge * w
        for at in _chunks(len(x)):
            part = prepare(x[at])
            part = np.column_stack((np.ones(len(part)), part))
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curvature = curvature + (part * (weight[at] * p * (1 - p) + 1e-9)[:, None]).T @ part
            gradient = gradient + part.T @ (weight[at] * (y[at] - p))
        step = np.linalg.solve(curvature, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
    mean = x.mean(0, dtype=np.float64)
    scale = np.sqrt(sum((((x[at] - mean) ** 2).sum(0) for at in _chunks(len(x))), np.zeros(x.shape[1])) / max(1, len(x)))
    scale = np.where(scale > 1e-9, scale, 1.0)
    return View(mean, scale, _logistic(x, y, weight, prepare=lambda part: _standard(part, mean, scale)))


class Model(NamedTuple):
    text: View
    meta: View
    blend: np.ndarray
    threshold: float

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        z = self.blend[0] + self.blend[1] * self.text.score(text) + self.blend[2] * self.meta.score(meta)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def co_train(x: list[np.ndarray], y: np.ndarray, aside: np.ndarray, extra: list[np.ndarray]) -> Model | None:
    """x: both views of labelled rows, y: their labels, aside: rows kept for calibration, extra: both views of unlabelled rows."""
    train = ~aside
    if len(np.unique(y[train])) < 2 or len(np.unique(y[aside])) < 2:
        train = aside = np.ones(len(y), dtype=bool)
        if len(np.unique(y)) < 2:
            return None
    sets = [[x[v][train], y[train].astype(float), np.ones(int(train.sum()))] for v in (0, 1)]
    open_ = np.ones(len(extra[0]), dtype=bool)
    good = y[train].mean()
    views = [fit_view(*s) for s in sets]
    for _ in range(ROUNDS):
        for v in (0, 1):
            places = np.flatnonzero(open_)
            if not len(places):
                break
            p = 1 / (1 + np.exp(-views[v].score(extra[v][places])))
            up, down = places[p >= SURE], places[p <= 1 - SURE]
            up = up[np.argsort(-p[p >= SURE], kind="stable")][:int(ADDED * good)]
            down = down[np.argsort(p[p <= 1 - SURE], kind="stable")][:int(ADDED * (1 - good))]
            found = np.concatenate((up, down))
            open_[found] = False
            other = sets[1 - v]
            other[0] = np.concatenate((other[0], extra[1 - v][found]))
            other[1] = np.concatenate((other[1], np.ones(len(up)), np.zeros(len(down))))
            other[2] = np.concatenate((other[2], np.full(len(found), 0.5)))
        views = [fit_view(*s) for s in sets]
    scores = np.column_stack([views[v].score(x[v][aside]) for v in (0, 1)])
    blend = _logistic(scores, y[aside].astype(float), np.ones(len(scores)), penalty=0.1)
    model = Model(views[0], views[1], blend, 0.0)
    kept = model.probability(x[0][aside], x[1][aside])[y[aside] == 1]
    return model._replace(threshold=float(min(0.5, np.quantile(kept, 1 - KEEP_GOOD))))


_INPUT = ["text", "lang", "source", "n_chars"]


def _inputs(docs: DataFrame) -> list:
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    have = {c.lower() for c in docs.columns}
    return [(docs[f"`{c}`"] if c in have else F.lit(None)).cast(kinds[c]) for c in _INPUT]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id",
                labelled_rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model | None:
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(F.min(label).cast("double").alias("y"))
    n_known, n_all = known.count(), max(1, docs.count())
    space = 1 << 40
    h = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(space))
    share = min(1.0, labelled_rows / max(1, n_known))
    others = min(1.0, unlabelled_rows / n_all)
    rows = docs.select(docs[f"`{id_column}`"].alias("id"), *(c.alias(n) for c, n in zip(_inputs(docs), _INPUT))).filter(F.col("id").isNotNull() & (h < int(space * max(share, others))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            text, meta, n = features(batch)
            wide = np.column_stack((text, meta)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(wide) + 1) * wide.shape[1], pa.int32()), pa.array(wide.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(n, pa.int64())], names=["id", "x", "n"])

    id_type = rows.schema["id"].dataType.simpleString()
    drawn = rows.mapInArrow(lean(run), f"id {id_type}, x array<float>, n long").filter("n > 0")
    sample = drawn.join(known.filter(h < int(space * share)).withColumn("aside", F.pmod(F.xxhash64("id", F.lit(6)), F.lit(5)) == 0), "id", "left")
    sample = sample.filter(F.col("y").isNotNull() | (h < int(space * others))).select("id", "x", "y", "aside").limit(3 * (labelled_rows + unlabelled_rows))
    table = sample.toArrow().combine_chunks()
    if not len(table):
        return None
    table = table.take(pc.sort_indices(table.select(["id"]), sort_keys=[("id", "ascending")]))
    flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
    n_text = len(_CLASSES) + 9 + WORD_BUCKETS
    y = table.column("y").to_numpy(zero_copy_only=False)
    has = ~np.isnan(y)
    aside = np.array([bool(a) for a in table.column("aside").to_pylist()])
    return co_train([flat[has, :n_text], flat[has, n_text:]], y[has], aside[has], [flat[~has, :n_text], flat[~has, n_text:]])


def score_quality(docs: DataFrame, model: Model | None, score: str = "score", keep: str = "keep") -> DataFrame:
    """All columns and two more: the probability that the document is good, and whether it is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (score, keep)]
    own = [free_name(docs.columns, f"_{n}") for n in _INPUT]
    source = docs.select(*(docs[f"`{c}`"] for c in rest), *(c.alias(n) for c, n in zip(_inputs(docs), own)))
    schema = T.StructType([*source.schema.fields[:len(rest)], T.StructField(score, T.DoubleType()), T.StructField(keep, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, own[0]):
            text, meta, n = features(pa.RecordBatch.from_arrays([batch.column(c) for c in own], names=_INPUT))
            if model is None:
                p, kept = np.zeros(len(n)), n > 0
            else:
                p = model.probability(text, meta)
                kept = (p >= model.threshold) & (n > 0)
            scores = pa.array(p, pa.float64(), mask=(n == 0) | (model is None))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), scores, pa.array(kept)], names=[*rest, score, keep])

    return source.mapInArrow(lean(run), schema)
