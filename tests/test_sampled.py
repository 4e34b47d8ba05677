"""Sampled variance order and additive corrections against plain loops."""

import math
import random

import numpy as np
import pytest

from varileaf.operators import select
from varileaf.plans import compose


def test_near_variance_is_a_loop_over_rows():
    rng = np.random.default_rng(1)
    z = np.round(rng.normal(size=(60, 2)), 1)
    z[10:14] = z[9]  # equal rows
    for k in (1, 3, 10):
        expected = []
        for a in z:
            near = sorted(((a - b) ** 2).sum() for b in z)[: min(k + 1, 8)]
            d = [math.sqrt(x) for x in near if x > 1e-15][:k]
            expected.append(np.var(d) if len(d) > 1 else 0.0)
        assert np.allclose(select.near_variance(z, k), expected)
    assert select.near_variance(z[:1]).tolist() == [0.0] and select.near_variance(np.zeros((5, 2))).tolist() == [0.0] * 5


def test_partitions_are_sampled_or_ordered(spark):
    rng = random.Random(2)
    sizes = {0: 900, 1: 900, 2: 100, 3: 100, 4: 1, 5: 30}
    rows = [(i, p, rng.gauss(0, 1), rng.gauss(0, 1)) for i, p in enumerate(p for p, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "id int, partition_id int, z_a double, z_b double").cache()
    budgets = {0: 50, 1: 450, 2: 70, 3: 20, 4: 3, 5: 0}
    picked = select.select(df, ["id"], ["z_a", "z_b"], budgets, "sampled_variance", 7).toPandas()
    assert picked.groupby("partition_id").size().to_dict() == {0: 50, 1: 450, 2: 70, 3: 20, 4: 1} and picked.id.is_unique
    order = {r.id: r["rank"] for r in select.ranked(df, ["id"], 7).collect()}
    z = {r[0]: np.array(r[2:]) for r in rows}
    for p in (0, 3):  # by variance among the first 400 of the seeded order
        pool = sorted((i for i, q, *_ in rows if q == p), key=order.get)[:400]
        score = np.round(select.near_variance(np.array([z[i] for i in pool])), 12)
        best = [pool[k] for k in np.argsort(-score, kind="stable")[: budgets[p]]]
        assert picked[picked.partition_id == p].sort_values("selection_rank").id.tolist() == best
    for p in (1, 2):  # the seeded order itself
        assert picked[picked.partition_id == p].sort_values("selection_rank").id.tolist() == sorted((i for i, q, *_ in rows if q == p), key=order.get)[: budgets[p]]
    assert select.select(df.limit(0), ["id"], ["z_a", "z_b"], budgets, "sampled_variance").count() == 0


def test_the_grid_of_alphas_is_a_loop(spark):
    rng = random.Random(3)
    rows = [([rng.gauss(0, 2) for _ in range(4)], rng.randrange(4), [rng.gauss(0, 1) for _ in range(4)] if i % 5 else None) for i in range(80)]
    df = spark.createDataFrame([*rows, (None, 1, None), ([1.0] * 4, None, None)], "logits array<double>, target int, bias array<double>")
    found = compose.alpha_losses(df, "logits", "target", "bias", [0.0, 0.5, 3.0])
    for a, loss in found.items():
        each = []
        for logits, target, bias in rows:
            m = [x + a * b for x, b in zip(logits, bias or [0.0] * 4, strict=True)]
            each.append(math.log(sum(math.exp(x) for x in m)) - m[target])
        assert loss == pytest.approx(sum(each) / len(each))


def test_corrections_lower_the_loss(spark):
    rng = random.Random(4)

    def made(n):
        out = []
        for i in range(n):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            out.append((i, a, b, [0.1 * a, 0.0, -0.1 * a], int(a + b > 0.8) * 2 + int(-0.8 < a + b < 0)))
        return spark.createDataFrame(out, "id int, a double, b double, logits array<float>, target int").cache()

    train, valid = made(400), made(150)
    before = compose.alpha_losses(valid.selectExpr("logits", "target", "cast(null as array<double>) as bias"), "logits", "target", "bias", [0.0])[0.0]
    held, story = compose.corrected(train, valid, ["a", "b"], ["id"], "logits", "target", 2, (0.0, 1.0, 4.0))
    assert [loss for _, loss in story] == sorted((loss for _, loss in story), reverse=True) and story[0][1] < before and len(story) == 2
    after = compose.alpha_losses(held.selectExpr("logits", "target", "cast(null as array<double>) as bias"), "logits", "target", "bias", [0.0])[0.0]
    assert held.count() == 150 and after == pytest.approx(story[-1][1])
