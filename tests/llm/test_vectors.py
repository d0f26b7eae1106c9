"""Embedding near-dedup and nearest neighbours against brute force, and their edge cases."""

import numpy as np
import pytest

from shoalgrid.llm import embedding_dedup, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, rank int"


def _vectors(n=300, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    for k in range(0, n, 7):  # near copies of the row before, at many distances
        v[k] = v[k - 1] + rng.standard_normal(dim) * rng.uniform(0, 0.5)
    return v.astype(np.float32)


def _rows(v, labels):
    return [(k, [float(x) for x in row], lab, "x", 9) for k, (row, lab) in enumerate(zip(v, labels))]


def _expected(v, labels, threshold):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= threshold) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    comp = np.arange(len(v))
    for _ in range(len(v)):
        new = np.minimum(comp, np.where(near, comp[None, :], len(v)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    return near.sum(axis=1), comp


def test_links_and_components_match_brute_force(spark):
    v = _vectors()
    labels = [(k + 1) // 7 % 3 for k in range(len(v))]
    got = embedding_dedup.near_vectors(spark.createDataFrame(_rows(v, labels), SCHEMA), block_rows=40).toPandas().sort_values("vec_id")
    links, comp = _expected(v, labels, 0.93)
    assert links.sum() > 20
    assert got["n_links"].tolist() == links.tolist()
    assert got["component_id"].tolist() == comp.tolist()
    assert got["kept"].tolist() == [i == c for i, c in enumerate(comp)]


def test_vectors_that_take_no_part(spark):
    one = [1.0, 0.0]
    rows = [(1, one, 0), (2, one, 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (7, one, None), (8, [1.0, None], 0), (9, [1.0], 0), (2, one, 0), (None, one, 0), (10, [], 0)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
    alone = {(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10)}
    assert got == alone | {(1, 1, 1, True), (2, 1, 1, False), (None, None, None, None)}
    assert embedding_dedup.near_vectors(df).count() == len(rows)


def test_empty_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_vectors(empty).count() == 0
    assert nearest.nearest_neighbours(empty, empty).count() == 0


def test_least_collisions_is_the_binomial_quantile():
    assert embedding_dedup.least_collisions(32, 10.0, 0.93, 1e-5) == 32
    assert embedding_dedup.least_collisions(32, 0.0, 0.93, 1e-5) == 0
    k = embedding_dedup.least_collisions(32, 0.85, 0.93, 1e-5)
    d = np.random.default_rng(0).standard_normal((20000, 32)) * np.sqrt(2 - 2 * 0.93)
    assert ((np.abs(d) <= 0.85).sum(axis=1) < k).mean() < 1e-3


def test_neighbours_recall_order_and_ties(spark):
    v = _vectors(600, 16, 3)
    v[5] = v[10] = v[20]
    rows = [(k, [float(x) for x in row], 0, "x", 1) for k, row in enumerate(v)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearest.nearest_neighbours(df, df.where("vec_id % 20 = 0"), block_rows=100, block_queries=7).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        order = np.lexsort((np.arange(len(d)), d))[:10]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11))
        assert np.allclose(g["score"], d[g["vec_id"]])
        hits += len(set(order) & set(g["vec_id"]))
    assert hits >= 0.9 * len(got)
    twenty = got[(got["query_id"] == 20)].sort_values("rank")["vec_id"].tolist()
    assert twenty[:2] == [5, 10]


def test_queries_in_small_lists_still_find_k_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(20, 8)) * 10, 30, axis=0) + rng.normal(size=(600, 8)) * 0.01
    v = np.vstack([v, rng.normal(size=(4, 8)) * 300])  # outliers, each a list of its own
    df = spark.createDataFrame([(k, [float(x) for x in row], 0, "x", 1) for k, row in enumerate(v)], SCHEMA)
    monkeypatch.setattr(nearest, "probes_needed", lambda *_: 1)
    monkeypatch.setattr(nearest, "centroids", lambda *_: np.vstack([v[:600:30], v[600:]]))
    got = nearest.nearest_neighbours(df, df).groupBy("query_id").count().toPandas()
    assert len(got) == 604 and (got["count"] == 10).all()


def test_neighbours_of_few_and_unusable_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 0.0]), (None, [1.0, 1.0]), (1, [0.0, 1.0]), (5, [1.0])]
    df = spark.createDataFrame([(*r, 0, "x", 0) for r in rows], SCHEMA)
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in nearest.nearest_neighbours(df, df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.414214), (1, 1, 0, 1.414214)]


@pytest.mark.parametrize("slack", [0.0, 2.5])
def test_scan_abandons_only_far_rows(slack):
    rng = np.random.default_rng(7)
    q, rows = rng.standard_normal((20, 64)), rng.standard_normal((2000, 64))
    i, j, d = nearest.adaptive_scan(q, rows, 5, nearest.rotation(64), np.zeros((20, 2000), bool), slack=slack)
    exact = np.sqrt(((q[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2))
    assert np.allclose(d, exact[i, j])
    best = {(a, b) for a in range(20) for b in np.argsort(exact[a])[:5]}
    assert len(best & set(zip(i.tolist(), j.tolist()))) >= (0.95 if slack else 0.3) * len(best)


@pytest.mark.parametrize(("shift", "scale"), [(0.0, 1.0), (10.0, 1.0), (100.0, 1.0), (1e6, 1.0), (0.0, 1e-25), (0.0, 1e25), (3.0, 1e200), (0.0, 1e-200)])
def test_scan_of_shifted_huge_and_tiny_vectors(shift, scale):
    g = np.random.default_rng(12)
    v = ((g.standard_normal((8, 64))[g.integers(0, 8, 2000)] + 0.01 * g.standard_normal((2000, 64))) + shift) * scale
    rows, own = v, np.arange(40)[:, None] == np.arange(2000)[None, :]
    i, j, score = nearest.adaptive_scan(v[:40], rows, 10, nearest.rotation(64), own)
    u = v / scale
    hits = 0
    for x in range(40):
        d = np.sqrt(((u - u[x]) ** 2).sum(axis=1))
        d[x] = np.inf
        want = np.argsort(d, kind="stable")[:10]
        got = j[i == x]
        hits += len(set(got) & set(want))
        assert np.allclose(score[i == x] / scale, d[got], rtol=1e-9, atol=0)
    assert hits >= 0.98 * 400


@pytest.mark.parametrize(("shift", "scale"), [(100.0, 1.0), (0.0, 1e25)])
def test_search_of_shifted_and_huge_vectors(spark, shift, scale):
    g = np.random.default_rng(13)
    v = (g.standard_normal((3, 32))[g.integers(0, 3, 3000)] + 0.01 * g.standard_normal((3000, 32)) + shift) * scale
    rows = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = nearest.nearest_neighbours(rows, rows.where("vec_id % 100 = 0")).collect()
    hits = 0
    for x in range(0, 3000, 100):
        d = np.sqrt((((v - v[x]) / scale) ** 2).sum(axis=1))
        d[x] = np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == x} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 300
