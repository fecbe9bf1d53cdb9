"""Vector operators and the pipeline against brute force."""

import numpy as np
import pytest

from matchloom.llm import embedding_dedup, hilbert_search
from matchloom.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(n=300, d=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[50:90] = x[50] + r.normal(size=(40, d)) * 0.08
    x[100:130] = x[100]
    x[131] = 3 * x[130]
    x = x.astype(np.float32)
    rows = [(i, x[i].tolist(), int(i % 3) if not 50 <= i < 135 else 1) for i in range(n)]
    rows[5] = (5, None, 1)
    rows[6] = (6, [0.0] * d, 1)
    rows[7] = (7, [float("nan")] + [1.0] * (d - 1), 1)
    rows[8] = (8, [1.0] * d, None)
    rows[9] = (9, [1.0] * 5, 1)
    rows[10] = (10, [None] + [1.0] * (d - 1), 1)
    return rows


def brute(rows):
    links = {i: set() for i, _, _ in rows}
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += links[k]
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_duplicates(spark, chunk):
    rows = rows_of()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), chunk=chunk).collect()}
    assert got == brute(rows)


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hilbert_search.search(spark.createDataFrame([], SCHEMA)).count() == 0
    only = hilbert_search.search(spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (None, [1.0, 1.0], 1)], SCHEMA)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in only] == [(0, 1, 1, 4.0)]


def test_search_recall_and_ties(spark):
    rows = [r for r in rows_of(600, 16, 3) if r[0] not in (5, 6, 7, 9, 10)]
    got = {}
    for r in hilbert_search.search(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    x = {i: np.array(v, float) for i, v, _ in rows}
    hit = n = 0
    for q in [i for i in x if i % 20 == 0]:
        order = sorted((-(x[q] * x[i]).sum(), i) for i in x if i != q)[:20]
        assert list(got[q]) and sorted(got[q]) == list(range(1, 21))
        found = [got[q][k] for k in range(1, 21)]
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        assert all(s == (x[q] * x[i]).sum() for i, s in found)
        hit += len({i for i, _ in found} & {i for _, i in order})
        n += 20
    assert hit / n >= 0.9


def test_search_narrow_windows_over_many_parts(spark, monkeypatch):
    r = np.random.default_rng(4)
    centres = r.normal(size=(150, 32))
    x = centres[r.integers(0, 150, 6000)] + r.normal(size=(6000, 32)) * 0.1
    x[1000:3000] = x[1000]
    x = x.astype(np.float32)
    fits = []
    plain = hilbert_search.Curves.fit
    monkeypatch.setattr(hilbert_search.Curves, "fit", lambda self, gaps: (plain(self, gaps), fits.append((self.used, self.half))))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for q in hilbert_search.search(rows, part=256).collect():
        got.setdefault(q.query_id, {})[q["rank"]] = (q.vec_id, q.score)
    # the windows of all curves together hold less than a fifth of the distinct vectors
    assert fits[0][0] * 2 * fits[0][1] < 0.2
    y = x.astype(float)
    hit = 0
    assert sorted(got) == list(range(0, 6000, 20))
    for q, found in got.items():
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(6000), -s))[:20]
        assert sorted(found) == list(range(1, 21)) and all(np.isclose(score, s[i]) for i, score in found.values())
        assert [found[k] for k in range(1, 21)] == sorted(found.values(), key=lambda p: (-p[1], p[0]))
        hit += len(set(best.tolist()) & {i for i, _ in found.values()})
    assert hit / (20 * len(got)) >= 0.9


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.99, 0.1], 1), (20, [1.0, 0.0], 1), (20, [0.0, 1.0], 1)]
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (20, 0, 20, True), (20, 3, 1, False)]
    found = hilbert_search.search(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.query_id for r in found} == {20} and all(r.vec_id in (1, 2) for r in found)


def test_hilbert_curve_is_continuous():
    cells = np.array([[i, j] for i in range(8) for j in range(8)])
    order = cells[np.argsort(hilbert_search.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (300, 301), (300, 302)]
    out = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
