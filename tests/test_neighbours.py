"""Nearest rows against brute force, with the other side whole in the sample and beyond it."""

import math
import random

import pytest

from varileaf.operators import neighbours


def plain(query, reference, exclude_self):
    out = []
    for i, x in query:
        near = [math.dist(x, y) for j, y in reference if None not in y and not any(map(math.isnan, y)) and not (exclude_self and i == j)] if None not in x else []
        out.append((i, min(near) if near else None))
    return sorted(out, key=str)


def made(seed, n, d, grid=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        centre = rng.choice([0, 0, 5, 40])
        rows.append((i, [round(centre + rng.gauss(0, 1), 1 if grid else 9) for _ in range(d)]))
    return rows


def frame(spark, rows, d):
    return spark.createDataFrame([(i, *x) for i, x in rows], "id long, " + ", ".join(f"c{k} double" for k in range(d)))


def check(spark, query, reference, d, exclude_self):
    got = neighbours.nearest(frame(spark, query, d), frame(spark, reference, d), [f"c{k}" for k in range(d)], ["id"], exclude_self).collect()
    want = plain(query, reference, exclude_self)
    assert len(got) == len(want)
    for a, b in zip(sorted(((r.id, r.distance) for r in got), key=str), want, strict=True):
        assert a[0] == b[0] and (a[1] is None) == (b[1] is None) and (b[1] is None or abs(a[1] - b[1]) < 1e-9), (a, b)


@pytest.mark.parametrize("beyond", [False, True])
@pytest.mark.parametrize("d,grid", [(2, True), (3, False), (12, False)])
def test_nearest(spark, monkeypatch, beyond, d, grid):
    if beyond:
        monkeypatch.setattr(neighbours, "SAMPLE_CELLS", 40 * d)
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", 25)
    rows = made(1, 500, d, grid)
    check(spark, made(2, 300, d, grid), rows, d, False)
    check(spark, rows, rows, d, True)


@pytest.mark.parametrize("beyond", [False, True])
def test_odd_rows(spark, monkeypatch, beyond):
    if beyond:
        monkeypatch.setattr(neighbours, "SAMPLE_CELLS", 8)
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    rows = made(3, 80, 2) + [(100, [1.0, None]), (101, [math.nan, 1.0])] + [(200 + i, [7.0, 7.0]) for i in range(60)]
    query = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (1, [9.0, 9.0]), (2, [None, 1.0]), (3, [7.0, 7.0]), (4, [1e6, -1e6])]
    check(spark, query, rows, 2, False)
    check(spark, [r for r in rows if r[0] != 101], rows, 2, True)
    check(spark, query, [], 2, False)
    check(spark, [], rows, 2, False)
    check(spark, rows[:1], rows[:1], 2, True)


def test_cells_that_are_too_far_are_not_visited(spark, monkeypatch):
    """Two far groups: what lies in one meets no block of the other."""
    monkeypatch.setattr(neighbours, "SAMPLE_CELLS", 60)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 10)
    rows = [(i, [(i % 2) * 1e6 + random.Random(i).random(), 0.0]) for i in range(400)]
    df = frame(spark, rows, 2)
    out = neighbours.nearest(df, df, ["c0", "c1"], ["id"], exclude_self=True)
    assert out.count() == 400 and out.where("distance > 1").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 6
