"""The projection of categories against a recursive tree over rows, and models that use it."""

import math
import random

import numpy as np
import pytest

from varileaf.operators.projection import PROJECTION, depth_for
from varileaf.operators.scaling import Scaler
from varileaf.plans.model import FittedModel, Partitioner


def tree_means(codes, y, depth, least):
    """Predictions of a recursive tree: cuts between values that occur, the greatest decrease of squares, the first of equals."""
    out = np.full(len(y), y.mean())
    if depth == 0 or len(y) < 2 * least or y.std() < 1e-9:
        return out
    best = None
    for j in range(codes.shape[1]):
        values = np.unique(codes[:, j])
        for a, b in zip(values, values[1:], strict=False):
            left = codes[:, j] <= (a + b) / 2
            if min(left.sum(), (~left).sum()) >= least:
                gain = y.var() * len(y) - y[left].var() * left.sum() - y[~left].var() * (~left).sum()
                if best is None or gain > best[0] + 1e-7 * abs(best[0]):
                    best = (gain, left)
    if best:
        for side in (best[1], ~best[1]):
            out[side] = tree_means(codes[side], y[side], depth - 1, least)
    return out


def made(seed, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.choice("ABCDEFG"), rng.choice(["1", "10", "2"]), rng.choice(["x", "y"])
        rows.append((i, rng.gauss(0, 1), a, b, c, (a in "BDF") * 3.0 + (a in "AG" and c == "x") * 5.0 + (b == "10") + rng.randint(0, 3)))
    return rows


@pytest.mark.parametrize("columns", [["a"], ["a", "b", "c"]])
def test_projection_is_the_trees(spark, columns):
    rows = made(1)
    df = spark.createDataFrame(rows, "i long, x double, a string, b string, c string, y double")
    at = {"a": 2, "b": 3, "c": 4}
    codes = np.array([[sorted({q[at[c]] for q in rows}).index(p[at[c]]) for c in columns] for p in rows])
    y = np.array([p[5] for p in rows])
    want = tree_means(codes, y, depth_for(len(np.unique(codes, axis=0))), max(10, len(y) // 100))
    want = (want - want.mean()) / (want.std() + 1e-10)
    scaler = Scaler(columns, categorical=columns).fit(df).project(df, "y")
    got = [r[PROJECTION] for r in scaler.transform(df, ["i"]).orderBy("i").collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_depths():
    assert [depth_for(u) for u in (1, 4, 7, 8, 15, 16, 500)] == [2, 2, 2, 3, 3, 4, 4]


def test_labels_that_only_two_columns_tell(spark):
    """Neither column gains anything alone."""
    rows = [(i, "pq"[i % 2], "uv"[i // 2 % 2], float((i % 2) ^ (i // 2 % 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, a string, b string, y double")
    got = [r[PROJECTION] for r in Scaler(["a", "b"], categorical=["a", "b"]).fit(df).project(df, "y").transform(df, ["i"]).orderBy("i").collect()]
    assert np.allclose(got, [2 * r[3] - 1 for r in rows], atol=1e-6)


def test_constant_missing_and_no_labels(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 1.0, None, float(i % 2) if i < 60 else None) for i in range(80)], "i long, a string, one double, no double, some double")
    for y, want in (("one", [0.0] * 80), ("no", [0.0] * 80), ("some", [-1.0, 1.0] * 40)):
        scaler = Scaler(["a"], categorical=["a"]).fit(df).project(df, y)
        assert np.allclose([r[PROJECTION] for r in scaler.transform(df, ["i"]).orderBy("i").collect()], want, atol=1e-6)


def test_fit_with_categories_and_y(spark, tmp_path):
    df = spark.createDataFrame(made(2), "i long, x double, a string, b string, c string, y double").cache()
    settings = Partitioner(min_gain=0.0, n_partitions=12)
    model = settings.fit(df, ["x", "a", "b"], ["i"], "y", categorical=["a", "b"])
    assert model.z == ["z_x", "z_a", "z_b", PROJECTION] and PROJECTION in model.tree.columns
    assert any(k.feature == 3 for k in model.tree.nodes)
    assert PROJECTION not in settings.fit(df, ["x", "a"], ["i"], categorical=["a"]).z and PROJECTION not in settings.fit(df, ["x"], ["i"], "y").z
    assigned = model.assigned().orderBy("i").collect()
    made_rows = model.expand(200)
    assert made_rows.columns == ["partition_id", "synthetic_id", "x", "a", "b"] and made_rows.count() == 200
    assert model.reduce(n=90).count() == 90 and set(model.transform(df).columns) == {*df.columns, "partition_id"}
    model.save(spark, str(tmp_path / "m"))
    again = FittedModel.load(spark, str(tmp_path / "m"), df, settings)
    assert again.assigned().orderBy("i").collect() == assigned
    assert math.isclose(sum(r[PROJECTION] for r in assigned), 0, abs_tol=1e-6)
