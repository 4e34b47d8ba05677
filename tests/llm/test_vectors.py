"""Whitening against an eigendecomposition of the covariance, clustering against plain Lloyd rounds, and what both leave out."""

import hashlib
import math

import numpy as np
import pytest

from varileaf.llm import lloyd, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, distance string, n string, `a.b` int"


def whitened(rows, components):
    """By id: deviation, whitened up to sign, and explained, from the covariance's eigenvectors."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = ((n * x - s) / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return ((n * x - s) ** 2).sum(axis=1).tolist(), y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def check(got, rows, components):
    deviation, z, explained = whitened(rows, components)
    by = sorted(got, key=lambda r: (r.vec_id, r.component))
    assert len(by) == len(rows) * components
    mine = np.array([r.whitened for r in by]).reshape(len(rows), components)
    assert np.abs(mine * np.sign((mine * z).sum(axis=0)) - z).max() < 1e-8
    for r in by:
        assert r.n == len(rows) and r.identity_error < 1e-9 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert [r.deviation for r in by[::components]] == deviation


def test_whitening(spark):
    df = vectors.embeddings(spark, SF)
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    check(whitening.whiten(df.repartition(7)).collect(), rows, 8)


def test_jacobi():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 8, 33):
        r = rng.normal(size=(max(1, d - 1), d)) * 10.0 ** rng.integers(-6, 6, d)
        lengths, v = whitening.jacobi(r)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)
        assert np.allclose(lengths[: min(r.shape)], np.linalg.svd(r, compute_uv=False), rtol=1e-12, atol=1e-12 * lengths[0])
        assert np.allclose(np.linalg.norm(r @ v, axis=0), lengths, atol=1e-12 * lengths[0])


def test_factors_of_parts_are_the_whole():
    x = np.random.default_rng(2).integers(-900, 900, (500, 6)) + 100_000
    parts = [whitening.factored(p) for p in (x[:3], x[3:4], x[4:200], x[200:])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whitening.joined(whole, p)
    assert (whole.n, whole.sums) == (500, x.sum(axis=0).tolist())
    assert np.allclose(whole.r.T @ whole.r, 500 * np.cov(x.T, bias=True), rtol=1e-12)


ODD = [(9, None), (10, []), (11, [1.0, None]), (12, [math.nan, 1.0]), (13, [math.inf, 1.0]), (14, [1.0])]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], SCHEMA)


def test_whitening_of_few_and_odd_rows(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.25, -3.0]), (3, [0.25, -3.0]), (4, [0.1, 2.0])]
    check(whitening.whiten(table(spark, rows + ODD)).collect(), rows, 2)
    repeated = whitening.whiten(table(spark, rows + rows + [(None, [1.0, 1.0])])).collect()
    assert len(repeated) == 18 and {r.n for r in repeated} == {9} and sum(r.vec_id is None for r in repeated) == 2
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert len(line) == 5 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    for none in ([], ODD[:5], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        assert whitening.whiten(table(spark, none)).collect() == []
    assert whitening.whiten(table(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries(spark):
    rows = [(1, [2.0**37, 1.0]), (2, [-(2.0**36), 3.0]), (3, [5.0, 2.0**35]), (4, [2.0**39, 1.0])]
    out = whitening.transform(table(spark, rows), whitening.fit(table(spark, rows))).collect()
    x = [[1024 * int(c) + 100_000 for c in v] for _, v in rows[:3]]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: int(r.deviation) for r in out} == {i + 1: sum((3 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in enumerate(x)}
    assert all(r.deviation is None for r in whitening.whiten(table(spark, rows)).collect())


def plain(rows, k, rounds, seed=3):
    x = {i: [math.floor(1024 * float(np.float32(c))) for c in v] for i, v in rows}
    first = sorted(x, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]
    c = [x[i] for i in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        own = {i: nearest(v)[1] for i, v in x.items()}
        for j in range(len(c)):
            mine = [x[i] for i in x if own[i] == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    near = {i: nearest(v) for i, v in x.items()}
    inertia = [sum(d for d, o in near.values() if o == j) for j in range(len(c))]
    return sorted((i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in near.items())


def test_lloyd(spark):
    df = vectors.embeddings(spark, SF)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, lloyd.cluster(df.repartition(5)).collect())) == plain(rows, 8, 10)
    assert lloyd.cluster(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("rounds", [0, 1, 2, 30])
def test_lloyd_with_ties_and_empty_clusters(spark, rounds):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(40)]  # six places only: equal centroids, whose larger numbers stay empty
    assert sorted(map(tuple, lloyd.cluster(table(spark, rows + ODD), k=9, rounds=rounds, dims=2).collect())) == plain(rows, 9, rounds)


def test_lloyd_of_few_and_odd_rows(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.25, -3.0])]
    assert sorted(map(tuple, lloyd.cluster(table(spark, rows + ODD), dims=2).collect())) == plain(rows, 8, 10)
    repeated = lloyd.cluster(table(spark, rows * 3 + [(None, [9.0, 9.0])]), k=2, dims=2).collect()
    assert len(repeated) == 7 and sum(r.vec_id is None for r in repeated) == 1
    assert lloyd.cluster(table(spark, [])).collect() == [] and lloyd.cluster(table(spark, ODD), dims=3).collect() == []


def test_only_changed_centroids_are_compared(monkeypatch):
    rng = np.random.default_rng(3)
    x, c = rng.integers(-50, 50, (300, 4)), rng.integers(-50, 50, (6, 4))
    owner, distance = lloyd.assign(x, c, np.arange(6), np.full(300, -1), np.zeros(300, np.int64))
    moved = c.copy()
    moved[2] += 7
    pairs = []
    true = lloyd.squared
    monkeypatch.setattr(lloyd, "squared", lambda a, b: pairs.append(len(a) * len(b)) or true(a, b))
    after, near = lloyd.assign(x, moved, np.array([2]), owner, distance)
    whole = true(x, moved)
    assert (after == whole.argmin(axis=1)).all() and (near == whole.min(axis=1)).all()
    assert sum(pairs) == 6 * (owner == 2).sum() + (owner != 2).sum()
    sums = np.zeros((6, 5), int)
    for before, now in ((np.full(300, -1), owner), (owner, after)):
        for t in lloyd.transfers(x, before, now):
            sums[t["cluster"], t["dim"] + 1] += t["amount"]
    assert sums.tolist() == [[int((after == j).sum()), *x[after == j].sum(axis=0).tolist()] for j in range(6)]


def test_distances_are_exact():
    x = np.array([[2**27 - 1, -(2**27) + 1] * 8, [3] * 16])
    assert lloyd.squared(x, -x).tolist() == [[sum((a + b) ** 2 for a, b in zip(p, q, strict=True)) for q in x.tolist()] for p in x.tolist()]
