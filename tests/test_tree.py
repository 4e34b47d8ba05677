"""Histograms by subtraction: the same trees as with all rows added, from fewer rows, whatever the batches are."""

import random

import numpy as np
import pytest

from varileaf.operators import tree


def table(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(rng.gauss(0, 1), rng.choice([0.0, 1.0]), float(rng.randint(0, 300)), rng.gauss(0, 1)) for _ in range(n)]
    return spark.createDataFrame([(*r, r[0] * (1 + r[1]) + (r[2] > 200) * 3 + r[3] ** 2) for r in rows], "a double, b double, c double, d double, t double")


@pytest.fixture(autouse=True)
def few_rows_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("criterion", ["squared_error", "absolute_error"])
def test_smaller_children_are_enough(spark, monkeypatch, criterion):
    df, columns = table(spark).cache(), ["a", "b", "c", "d"]
    sources = []
    true = tree._Source.__init__
    monkeypatch.setattr(tree._Source, "__init__", lambda self, *a: sources.append(self) or true(self, *a))
    grown = tree.grow(df, columns, "t", 24, 10, criterion=criterion)
    depth = max(x.depth for x in grown.nodes)
    assert len(grown.leaves) == 24 and sources[0].added <= 3000 + depth * 1500
    whole = tree._grown

    def every_child(source, *a):
        true_levels = source.levels

        def both(t, wanted, size):  # adds the larger children's rows too, and checks what subtraction makes of them
            if size > 1:
                left, right = t[2], t[3]
                pairs = [next((x, y) for x, y in zip(left, right, strict=True) if w in (x, y)) for w in wanted]
                parents = [int(np.flatnonzero((left == x) & (right == y))[0]) for x, y in pairs]
                others = [int(x + y - w) for w, (x, y) in zip(wanted, pairs, strict=True)]
                seen = true_levels(t, [*wanted, *others], size)
                for k, p in enumerate(parents):
                    assert np.allclose(seen[k] + seen[len(wanted) + k], kept[p], atol=1e-6)
                kept.update(zip([*wanted, *others], seen, strict=True))
                return seen[: len(wanted)]
            kept[0] = true_levels(t, wanted, size)[0]
            return kept[0][None]

        kept: dict = {}
        source.levels = both
        return whole(source, *a)

    monkeypatch.setattr(tree, "_grown", every_child)
    assert tree.grow(df, columns, "t", 24, 10, criterion=criterion).to_json() == grown.to_json()
    monkeypatch.setattr(tree, "_grown", whole)
    monkeypatch.setattr(tree, "LOCAL_CELLS", 0)
    spread = tree.grow(df, columns, "t", 24, 10, criterion=criterion)
    assert [(x.depth, x.n, x.feature, x.threshold) for x in spread.nodes] == [(x.depth, x.n, x.feature, x.threshold) for x in grown.nodes]


def test_dense_and_sparse_cells_are_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    bins, t, slot, fine = rng.integers(0, 9, (500, 3)).astype(np.uint8), rng.normal(size=500), rng.integers(-1, 4, 500), rng.integers(0, 5, 500)
    for given, kinds in ((fine, 5), (0, 1)):
        dense = tree.partial(bins, t, slot, given, 9, kinds, 4)
        monkeypatch.setattr(tree, "DENSE", 0)
        sparse = tree.partial(bins, t, slot, given, 9, kinds, 4)
        monkeypatch.undo()
        assert all(np.allclose(a, b) for a, b in zip(dense, sparse, strict=True))
        key = ((np.repeat(slot, 3) * 3 + np.tile(np.arange(3), 500)) * 9 + bins.ravel()) * kinds + (np.repeat(given, 3) if kinds > 1 else 0)
        assert dense[1].sum() == 3 * (slot >= 0).sum() and set(dense[0].tolist()) == set(key[np.repeat(slot, 3) >= 0].tolist())
    assert [len(x) for x in tree.partial(bins, t, np.full(500, -1), 0, 9, 1, 4)] == [0] * 4


def test_a_forest_is_its_trees(spark, monkeypatch):
    df = table(spark, 1500, 4).selectExpr("*", "cast(pmod(hash(a), 5) as int) as g").cache()
    columns = ["a", "b", "c", "d"]
    budgets = [6, 1, 3, 12, 4, 7]  # nothing is in the last group
    for cells in (tree.LOCAL_CELLS, 0):
        monkeypatch.setattr(tree, "LOCAL_CELLS", cells)
        forest = tree.grow_forest(df, "g", columns, "t", budgets, 10)
        assert [len(t.leaves) for t in forest.trees] == [6, 1, 3, 12, 4, 1]
        for k in (0, 2, 3, 4):
            alone = tree.grow(df.where(f"g = {k}"), columns, "t", budgets[k], 10)
            assert [(x.n, x.feature, x.threshold, x.left, x.leaf) for x in alone.nodes] == [(x.n, x.feature, x.threshold, x.left, x.leaf) for x in forest.trees[k].nodes]
    marked = df.withColumn("p", forest.leaf(df.g)).groupBy("p").count().collect()
    assert sorted((r.p, r["count"]) for r in marked) == list(enumerate(x.n for t in forest.trees[:5] for x in t.leaves))


def test_many_leaves_are_routed_in_batches(spark, monkeypatch):
    df = table(spark, 800, 5).cache()
    grown = tree.grow(df, ["a", "b", "c", "d"], "t", 40, 5)
    short = df.select(grown.leaf().alias("p"), grown.predict().alias("v")).collect()
    monkeypatch.setattr(tree, "EXPRESSION_LEAVES", 3)
    assert df.select(grown.leaf().alias("p"), grown.predict().alias("v")).collect() == short
