"""Selections and nearest rows over tables of many copies, and what reaches the driver."""

import numpy as np

from varileaf.operators import select
from varileaf.operators.neighbours import Boxed, least_distance


def _table(spark, z, part):
    rows = [(i, float(x), float(y), int(p)) for i, ((x, y), p) in enumerate(zip(z, part, strict=True))]
    return spark.createDataFrame(rows, "id long, x double, y double, partition_id int")


def test_only_so_many_candidates_reach_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(select, "GROUP_ROWS", 200)
    monkeypatch.setattr(select, "CANDIDATES", 400)
    sent, to_pandas = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: sent.append(len(out := to_pandas(self))) or out)
    z, part = np.random.default_rng(7).normal(size=(4000, 2)), np.arange(4000) % 4
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = select.select(_table(spark, z, part), ["id"], ["x", "y"], dict.fromkeys(range(4), 20), "fps").orderBy("partition_id", "selection_rank").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sent and max(sent) <= 600
    for p in range(4):
        mine = np.flatnonzero(part == p)
        assert [r.id for r in got if r.partition_id == p] == mine[select.centroid_fps(z[mine], 20)].tolist()


def test_copies_follow_when_all_different_rows_are_picked(spark, monkeypatch):
    monkeypatch.setattr(select, "GROUP_ROWS", 50)
    rng = np.random.default_rng(3)
    z = np.concatenate((rng.permutation(np.repeat(rng.normal(size=(30, 2)), 8, 0)), rng.permutation(np.repeat(rng.normal(size=(70, 2)), 4, 0))))
    part = np.repeat([0, 1], [240, 280])
    for method in ("fps", "medoid_fps", "mixed_fps"):
        got = select.select(_table(spark, z, part), ["id"], ["x", "y"], {0: 100, 1: 150}, method).orderBy("partition_id", "selection_rank").collect()
        for p, b in ((0, 100), (1, 150)):
            mine = np.flatnonzero(part == p)
            assert [r.id for r in got if r.partition_id == p] == mine[select.KERNELS[method](z[mine], b)].tolist()


def test_mixed_rest_by_variance_of_copies():
    """Copies are at distance 0, far from the origin too."""
    z = np.random.default_rng(2).permutation(np.repeat(np.random.default_rng(1).normal(size=(60, 2)) + 1e5, 6, 0))
    d = np.sqrt(np.sort(((z[:, None] - z[None]) ** 2).sum(2), 1)[:, :10])
    score = np.round(d.var(1), 12)
    head = select.centroid_fps(z, 70).tolist()
    assert select.mixed_fps(z, 100)[70:].tolist() == [i for i in np.argsort(-score, kind="stable").tolist() if i not in set(head)][:30]


def test_variance_order_of_copies():
    z = np.repeat(np.random.default_rng(1).normal(size=(60, 2)) + 1e5, 6, 0)
    d = np.sqrt(np.sort(((z[:, None] - z[None]) ** 2).sum(2), 1)[:, :10])
    assert select.variance_ordered(z, 360).tolist() == np.argsort(-np.round(d.var(1), 12), kind="stable").tolist()


def test_nearest_far_from_the_origin():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(500, 2)) + 1e7, rng.normal(size=(3000, 2)) + 1e7
    assert np.array_equal(least_distance(a, b), np.sqrt(((a[:, None] - b[None]) ** 2).sum(2).min(1)))


def test_search_looks_at_few_rows(monkeypatch):
    looked = []
    best = Boxed._best
    monkeypatch.setattr(Boxed, "_best", lambda self, a, rows, *rest: looked.append(len(a) * len(rows)) or best(self, a, rows, *rest))
    x = np.random.default_rng(5).random((20_000, 2))
    x = np.concatenate((x, x))
    same = np.arange(len(x))
    assert not least_distance(x, x, same).any()
    assert sum(looked) < len(x) ** 2 / 20


def _plain(z, budget, first):
    chosen, least = [first], ((z - z[first]) ** 2).sum(1)
    least[first] = -1
    while len(chosen) < budget:
        chosen.append(int(least.argmax()))
        np.minimum(least, ((z - z[chosen[-1]]) ** 2).sum(1), out=least)
        least[chosen[-1]] = -1
    return chosen


def test_picks_in_boxes():
    rng = np.random.default_rng(9)
    for n, d in ((700, 1), (900, 2), (1100, 4), (800, 7)):
        x = rng.normal(size=(n, d))
        for z in (x, x.round(1), np.repeat(x[: n // 4], 4, 0), np.zeros((n, d))):
            for budget in (select.FEW_PICKS + 1, len(z)):
                assert select.farthest(z, budget, 17).tolist() == _plain(z, budget, 17)


def test_rounds_only_beyond_what_one_call_picks_from(spark, monkeypatch):
    monkeypatch.setattr(select, "GROUP_ROWS", 200)
    rounds = []
    monkeypatch.setattr(select, "farthest_rounds", lambda *a, f=select.farthest_rounds: rounds.append(a) or f(*a))
    z = np.random.default_rng(12).normal(size=(500, 2))
    table, z = _table(spark, np.concatenate((z, z)), np.zeros(1000)), np.concatenate((z, z))

    def check():
        for method in ("fps", "medoid_fps"):
            got = select.select(table, ["id"], ["x", "y"], {0: 700}, method).orderBy("selection_rank").collect()
            assert [r.id for r in got] == select.KERNELS[method](z, 700).tolist()

    check()
    assert not rounds
    monkeypatch.setattr(select, "PICK_GROUPS", 1)
    check()
    assert len(rounds) == 2


def test_centroid_start_is_the_medoid_of_all_rows():
    z = np.random.default_rng(13).gamma(0.5, size=(3000, 2))
    assert select.centroid_fps(z, 1)[0] == ((z[:, None] - z[None]) ** 2).sum((1, 2)).argmin()
