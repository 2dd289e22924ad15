"""Vector operators against brute force, and the pipeline's stages."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlake.llm import near, topk
from sessionlake.llm.common import smallest_linked

ROWS = "vec_id long, embedding array<float>, label int"


def clustered(count, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, count)] * rng.uniform(0.5, 2, (count, 1)) + rng.normal(size=(count, 16)) * 0.12
    return np.round(x, 3), rng.integers(0, 3, count)


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(9001, None, 1), (9002, [], 1), (9003, [nan] * 16, 1), (9004, [inf] + [1.0] * 15, 1), (9005, [0.0] * 16, 1), (9006, [1.0, 2.0], 1), (9050, [1.0, None], 1), (9007, [1.0] * 16, None), (9008, [1.0] * 16, None)]


def test_top_k_is_exact(spark):
    x, _ = clustered(600, 1)
    x[10] = x[11]
    whole = np.floor(256 * x)
    rows = [(i, whole[i].tolist(), 0) for i in range(600)] + odd_rows()
    frame = spark.createDataFrame(rows, ROWS.replace("float", "double"))
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, 5, candidate_rows=64, query_rows=5)
    want = set()
    extra = np.vstack([whole, np.ones((2, 16))])
    ids = np.array([*range(600), 9007, 9008])
    for i in range(0, 600, 50):
        scores = extra @ whole[i]
        scores[i] = -np.inf
        order = np.lexsort((ids, -scores))[:5]
        want |= {(i, r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(order)}
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(frame.limit(0), F.lit(True), 5).count() == 0


def test_top_k_of_repeated_queries_and_candidates(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [-3.0, 1.0]), (100, [0.0, -1.0]), *[(i, [float(i), float(i % 3)]) for i in range(1, 9)], (8, [8.0, 2.0])]
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, id string, dim int")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, 5, candidate_rows=4, query_rows=2)
    want = []
    for q, x in rows:
        if q % 50 == 0:
            best = sorted((-int(np.dot(x, y)), i) for i, y in rows if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) == 20


def test_near_vectors_recall_and_odd_rows(spark):
    x, label = clustered(1500, 2)
    x[5:25] = x[4]
    label[4:25] = 1
    x = x.astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(1500)] + odd_rows(), ROWS)
    got = {r.id: r for r in near.near_groups(frame).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    n = np.array([got[i].n_links for i in range(1500)])
    assert (n <= link.sum(1) + 1).all() and n.sum() >= 0.9 * link.sum() and n[4] >= 20
    assert all(got[r[0]].n_links == 0 and got[r[0]].component_id == r[0] and got[r[0]].kept for r in odd_rows())
    assert near.near_groups(frame.limit(0)).count() == 0


def test_smallest_linked(spark):
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 400, (260, 2)).tolist() + [[i, i + 1] for i in range(1000, 1060)] + [[7, 7]]
    root = {}
    def top(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v
    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    links = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    got = {r.node: r.root for r in smallest_linked(links).collect()}
    assert got == {v: top(v) for v in root if v in got} and {v for v in root if top(v) != v} <= set(got)


def test_stages_keep_columns_and_clean_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == docs.columns, name
        sizes.append(out.count())
        if name == "quality classifier":
            good = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi").filter("length(trim(text)) > 0")
            assert good.join(out, "doc_id", "left_anti").count() <= 0.02 * good.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.filter("not round_trip").count() == 0 and last.count() == sizes[-1]


def test_recall_is_measured_where_links_are_rare(spark, monkeypatch):
    """Pairs whose ends hardly meet within a sample; a crowd that does must not decide for them."""
    monkeypatch.setattr(near, "SAMPLE_ROWS", 400)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    aside = rng.normal(size=(2000, 64))
    aside -= (aside * x[:2000]).sum(1)[:, None] * x[:2000]
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    x[2000:4000] = 0.935 * x[:2000] + np.sqrt(1 - 0.935 ** 2) * aside
    crowd = x[5999] + rng.normal(size=(600, 64)) * 0.01
    x[5000:5600] = crowd / np.linalg.norm(crowd, axis=1)[:, None]
    frame = spark.createDataFrame([(i, x[i].tolist(), 1) for i in range(6000)], ROWS.replace("float", "double"))
    got = {r.id: r.n_links for r in near.near_groups(frame).collect()}
    assert sum(got[i] > 0 for i in range(4000)) >= 0.97 * 4000
    assert sum(got[i] for i in range(5000, 5600)) >= 0.99 * 600 * 599


def test_without_evidence_made_links_set_the_cells():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    probe = near.Probe(near.fit_books(x, 200_000), x[:500], np.zeros(500), np.arange(500))
    counts = np.zeros((500, near.LEVELS), np.int64)
    assert near.visits_for(counts, lambda: probe.planted(near.THRESHOLD), 64 * 64) > 4
    assert near.visits_for(counts, None, 64 * 64) == 4
