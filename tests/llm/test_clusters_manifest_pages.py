"""Centroid clusters, Merkle manifests and page texts against brute force, with odd rows and hand-made pages."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sessionlake.llm import bisector, merkle, pages

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, id string, vector string"
HEX = hashlib.sha256


def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (HEX(f"1:{r[0]}".encode()).hexdigest(), r[1])) + sorted((r for r in kept if r[0] is None), key=lambda r: r[1])
    centres = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        groups = defaultdict(list)
        placed = []
        for i, v in kept:
            c = min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
            groups[c].append(v)
            placed.append((i, c, far(v, centres[c])))
        if turn < rounds:
            centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if groups[c] else centre for c, centre in enumerate(centres)]
    cap = lambda x: min(x, (1 << 63) - 1)
    own = Counter()
    for _, c, d in placed:
        own[c] += d
    return sorted(((i, c, cap(d), cap(own[c]), cap(sum(own.values())), HEX(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in placed), key=repr)


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [(None, [0.5] * 4), (7001, None), (7002, []), (7003, [nan, 1, 1, 1]), (7004, [inf, 1, 1, 1]), (7005, [None, 1.0, 1.0, 1.0]), (7006, [0.0] * 4), (7006, [0.0] * 4), (7007, [1.0] * 5)]


@pytest.mark.parametrize("wide", [False, True])
def test_clusters(spark, wide):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(9, 4))[rng.integers(0, 9, 300)] * 3 + rng.normal(size=(300, 4)) * 0.4, 1)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + odd_vectors()
    rows += [(8001, [1e30, -1e30, 0.0, 3.0]), (8002, [1e300, 1.0, 2.0, 3.0]), (8003, [2.0 ** 40, 1.0, 2.0, 3.0])] if wide else []
    frame = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "a", "b", "c") for i, v in rows], VECTORS)
    got = sorted((tuple(r) for r in bisector.cluster_vectors(frame, k=5, dims=4, scale=64).collect()), key=repr)
    assert got == brute_clusters(rows, 5, 3, 4, 64)


def test_clusters_of_few_and_no_rows(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], VECTORS)
    got = sorted((tuple(r) for r in bisector.cluster_vectors(frame, k=16, dims=2).collect()), key=repr)
    assert got == brute_clusters(rows, 16, 3, 2, 64)
    empty = bisector.cluster_vectors(frame.limit(0), dims=2)
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "cluster", "distance"]


def test_ties_favour_the_smaller_number():
    contest = bisector.Tournament([[0, 0], [2, 0], [4, 0], [2, 0]])
    winner, distance = contest.nearest(np.array([[1.0, 0], [3.0, 0], [2.0, 0], [-1.0, 5.0]]))
    assert winner.tolist() == [0, 1, 1, 0] and distance.tolist() == [1, 1, 0, 26]


@pytest.mark.parametrize("number", [0, 5, -5, 2 ** 30, -(2 ** 64) - 1, 10 ** 40])
def test_limbs_add_up(number):
    assert sum(digit << (bisector.LIMB * place) for place, digit in bisector.limbs(number)) == number


def brute_manifest(rows):
    h = lambda *parts: HEX("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(field, r))
    tamper = lambda r: (*r[:4], r[4].replace("\n", "")) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r

    def tree(nodes):
        """root, and per node its (left, right) siblings up to the root"""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, pos in enumerate(at):
                run = nodes[pos // 3 * 3:pos // 3 * 3 + 3]
                steps[i].append(("".join(run[:pos % 3]), "".join(run[pos % 3 + 1:])))
            at = [pos // 3 for pos in at]
            nodes = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        return nodes[0], steps

    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in sources[s]])
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, above):
        for r, steps in zip(sources[s], trees[s][1]):
            folded, proof = leaf(tamper(r)), ""
            for left, right in steps + top:
                folded, proof = h(left, folded, right), proof + left + right
            out.append((r[0], leaf(r), trees[s][0], root, h(proof), folded, folded == root))
    return sorted(out, key=repr)


def test_manifest(spark, odd, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", 2)  # blocks of nine leaves, so that trees are higher than a block
    rows = [(int(i), f"s{i % 4}" if i % 50 else f"é{i}", "en", i, f"line {i}\nnext\n" * (i % 3)) for i in range(400)] + [(i, "big", None, 1, "x\n") for i in range(1000, 1100)]
    rows += [(1000, "big", None, 1, "x\n"), (1000, "big", None, 1, "another\n"), (9, "", "de", None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    frame = frame.selectExpr("*", "'x' AS g", "1 AS pos", "'y' AS leaf", "2 AS n", "'z' AS digest")
    got = sorted((tuple(r) for r in merkle.verified_manifest(frame).collect()), key=repr)
    assert got == brute_manifest(rows)
    assert {r[-1] for r in got} == {True, False}
    got = sorted((tuple(r) for r in merkle.verified_manifest(odd).collect()), key=repr)
    assert got == brute_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()])


def test_manifest_of_no_and_one_row(spark, empty):
    assert merkle.verified_manifest(empty).count() == 0
    row = (5, None, "en", 3, "abc")
    got = [tuple(r) for r in merkle.verified_manifest(spark.createDataFrame([row], "doc_id long, source string, lang string, n_chars long, text string")).collect()]
    assert got == brute_manifest([row]) and got[0][1] == got[0][2] == got[0][3] == got[0][5]


PAGES = "page_id long, url string, html string, host string, hashes string, text int"


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("plain", "plain"),
    (page("<nav><a href='/'>menu</a></nav><article><h1>T &amp; U</h1><p><b>one<br><p>two\n  three</b></article><footer>foot</footer>"), "T & U\none\ntwo three"),
    (page("<div class='ad'>buy</div><main><p>a<script>if (a<b) x = \"</p>\"; '</div>'</script> b</p><p>c</main>end"), "a b\nc"),
    (page("<header><p>site</p></header><article><header><h1>title</h1></header><p>x</p><div id='comments'><p>nice</p></div><form><input value='q'>send</form></article>"), "title\nx"),
    (page("<div class='cookie-notice'>ok?</div><p>no article &lt;here&gt;</p><aside>side</aside>"), "no article <here>"),
    (page("<form><article><p>in a form</p></article><button>go</button></form>"), "in a form"),
    (page("<div class='sidebar-page'><article><p>kept</p></article></div>"), "kept"),
    (page("<ul><li>one<li>two <i>2</i></ul><table><tr><td>a<td>b<tr><td>c</table>"), "one\ntwo 2\na\nb\nc"),
    (page("<p>never closed <!-- hidden"), "never closed"),
    (page("<article><p>5 < 6 and a<b>c</b></p></article>"), "5 < 6 and ac"),
    (page("<article><p title=\"a > b\">x</p><p hidden>y</p><p style='display: none'>z</p></article>"), "x"),
    (page("<article></article><p>outside</p>"), ""),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<p>&nbsp;a&#160;&#x41;&unknown; &am</p>", "a A&unknown; &am"),
])
def test_one_page(html, text):
    assert pages.main_text(html, frozenset())[0] == text


def test_templates_by_host(spark):
    legal = "<div><p>All rights are reserved by us and by no one else, in any form whatever, for ever.</p></div>"
    share = "<div><a href='/s'>send this</a></div>"
    rows = [(i, f"https://a.example/{i}", f"<div id='top'>words of the site</div><div><h2>Story {i}</h2><p>{f'sentence {i} ' * 30}</p></div>{legal}", "x", "y", 1) for i in range(6)]
    rows += [(i, f"http://USER@b.example:80/{i}?q", page(f"<article><p>a text of its own, number {i}</p>{share}<div><p>same prose</p></div></article>"), "x", "y", 1) for i in range(10, 15)]
    copy = "<div><h2>Copied</h2><p>" + "the same words " * 20 + "</p></div>"
    rows += [(i, "https://c.example/", f"<div>advice {i}</div>{copy}", "x", "y", 1) for i in range(20, 26)]
    rows += [(30, None, f"<div>lonely</div>{legal}", "x", "y", 1), (31, "https://a.example/n", None, "x", "y", 1), (32, "https://d.example", f"<p>x</p>{legal}", "x", "y", 1), (32, "https://d.example", f"<p>x</p>{legal}", "x", "y", 1), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, PAGES).repartition(5)
    got = sorted(((r.page_id, r.text, r.n_chars, r.n_templates) for r in pages.page_texts(frame).collect()), key=repr)
    law = "All rights are reserved by us and by no one else, in any form whatever, for ever."
    want = [(i, f"Story {i}\n" + " ".join([f"sentence {i}"] * 30), 2) for i in range(6)] + [(i, f"a text of its own, number {i}\nsame prose", 1) for i in range(10, 15)]
    want += [(i, f"advice {i}\nCopied\n" + " ".join(["the same words"] * 20), 0) for i in range(20, 26)]
    want += [(30, f"lonely\n{law}", 0), (31, "", 0), (32, f"x\n{law}", 0), (32, f"x\n{law}", 0), (None, "", 0)]
    assert got == sorted(((i, t, len(t), n) for i, t, n in want), key=repr)
    joined = sorted(((r.page_id, r.text, r.n_chars, r.n_templates) for r in pages.page_texts(frame, broadcast_hashes=-1).collect()), key=repr)
    assert joined == got
    assert pages.page_texts(frame.limit(0)).count() == 0
