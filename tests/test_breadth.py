"""Breadth-first trees, cuts of two-valued columns and left-out columns, against a plain tree over rows."""

import random
from collections import deque

import pytest

from varileaf.operators import tree
from varileaf.plans.model import PRESETS

COLUMNS = ["a", "b", "flag", "rare"]


def rows_of(n=600, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, flag, rare = float(rng.randint(-6, 6)), float(rng.randint(-9, 9)), rng.choice([-0.5, 1.5]), 9.0 if rng.random() < 0.01 else -0.1
        out.append((a, b, flag, rare, a * (flag > 0) + abs(b) + 2 * (rare > 0) * a + rng.gauss(0, 0.3)))
    return out


def spread(t):
    return sum(x * x for x in t) - sum(t) ** 2 / len(t)


def plain(rows, leaves, least, depth, two, used):
    """Leaf of each row: a queue of nodes, each cut where the squared error falls most."""
    leaf, queue, done = [None] * len(rows), deque([(list(range(len(rows))), 0)]), 0
    while queue:
        own, level = queue.popleft()
        best = None
        if level < depth and done + len(queue) + 1 < leaves:
            for f in [f for f in used if f not in two] + [f for f in used if f in two]:
                values = sorted({r[f] for r in rows}) if f not in two else [0.0]
                for v in values:
                    left, right = [i for i in own if rows[i][f] <= v], [i for i in own if rows[i][f] > v]
                    if not left or not right or (f not in two and min(len(left), len(right)) < least):
                        continue
                    gain = spread([rows[i][4] for i in own]) - spread([rows[i][4] for i in left]) - spread([rows[i][4] for i in right])
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, left, right)
        if best is None or best[0] <= 1e-9 or min(len(best[1]), len(best[2])) < least:
            for i in own:
                leaf[i] = done
            done += 1
        else:
            queue += [(best[1], level + 1), (best[2], level + 1)]
    return leaf


@pytest.mark.parametrize("cells", [tree.LOCAL_CELLS, 0])
@pytest.mark.parametrize(("leaves", "least", "depth"), [(2, 20, 4), (6, 20, 4), (11, 5, 10), (40, 12, 3)])
def test_a_queue_of_nodes_gives_the_same_leaves(spark, monkeypatch, cells, leaves, least, depth):
    monkeypatch.setattr(tree, "LOCAL_CELLS", cells)
    rows = rows_of()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, flag double, rare double, t double").cache()
    assert tree.two_valued(df, COLUMNS) == {"flag", "rare"}
    made = tree.grow(df, COLUMNS, "t", leaves, least, depth, order="breadth")
    found = [r.p for r in df.select("i", made.leaf().alias("p")).orderBy("i").collect()]
    assert found == plain(rows, leaves, least, depth, {2, 3}, range(4))
    assert [x.n for x in made.leaves] == [found.count(k) for k in range(len(made.leaves))] and len(made.leaves) <= leaves


def test_a_two_valued_winner_with_a_small_side_leaves_the_node_whole(spark):
    rows = [(float(i % 4), 5.0 if i < 3 else -0.1, 100.0 * (i < 3) + 0.1 * (i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, rare double, t double")
    assert len(tree.grow(df, ["a", "rare"], "t", 8, 5, order="breadth").leaves) == 1
    assert len(tree.grow(df, ["a", "rare"], "t", 8, 5).leaves) > 1  # best-first has no such rule
    assert len(tree.grow(df, ["a", "rare"], "t", 8, 3, order="breadth").leaves) > 1


def test_columns_take_turns():
    columns = list("abcde")
    dropped = [set(columns) - set(tree.rotation(columns, 0.6, k)) for k in range(5)]
    assert all(len(x) == 2 for x in dropped) and sorted(c for x in dropped for c in x) == sorted(columns * 2)
    assert tree.rotation(columns, 1.0, 3) == columns and tree.rotation(columns, 0.01, 4) and tree.rotation([], 0.5, 1) == []


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_left_out_columns_are_not_cut(spark, seed):
    rows = rows_of(400, 7)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, flag double, rare double, t double").cache()
    kept = tree.rotation(["a", "b"], 0.5, seed)
    made = tree.grow(df, COLUMNS, "t", 7, 15, 4, seed=seed, order="breadth", colsample=0.5)
    used = [COLUMNS.index(c) for c in [*kept, "flag", "rare"]]
    found = [r.p for r in df.select("i", made.leaf().alias("p")).orderBy("i").collect()]
    assert found == plain(rows, 7, 15, 4, {2, 3}, sorted(used)) and made.columns == COLUMNS
    assert all(made.importances[c] == 0 for c in set(COLUMNS) - {COLUMNS[k] for k in used})
    best = tree.grow(df, COLUMNS, "t", 7, 15, 4, seed=seed, colsample=0.5)
    assert {COLUMNS[x.feature] for x in best.nodes if x.feature >= 0} <= {COLUMNS[k] for k in used}


def test_edge_tables_and_settings(spark):
    one = spark.createDataFrame([(1.0, 2.0)] * 3, "a double, t double")
    assert len(tree.grow(one, ["a"], "t", 4, 1, order="breadth").leaves) == 1
    for wrong in ({"order": "depth"}, {"colsample": 0.0}):
        with pytest.raises(ValueError):
            tree.grow(one, ["a"], "t", **wrong)
    rows = rows_of(300, 5)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, flag double, rare double, t double")
    model = PRESETS["pairwise"].set_params(growth="breadth", n_partitions=5, min_gain=0.0).fit(df, ["a", "b", "flag"], ["i"])
    sizes = {r.partition_id: r.size for r in model.get_partitions().collect()}
    assert sum(sizes.values()) == 300 and sorted(sizes) == list(range(len(sizes))) and 1 < len(sizes) <= 5
    again = tree.Tree.from_json(model.tree.to_json())
    assert again.nodes == model.tree.nodes
