"""Partitions within partitions: by brute force from fits of each group, and the number of jobs."""

import random

import pytest

from varileaf.operators import tree
from varileaf.plans import compose
from varileaf.plans.model import Partitioner


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(5)
    rows = [(i, *[rng.gauss(k % 3 * (i % 4), 1 + k) for k in range(5)]) for i in range(2000)]
    return spark.createDataFrame(rows, "i long, a double, b double, c double, d double, e double").repartition(4).cache()


def groups(frame):
    out = {}
    for r in frame.select("i", "partition_id").collect():
        out.setdefault(r.partition_id, set()).add(r.i)
    assert sorted(out) == list(range(len(out)))
    return {frozenset(x) for x in out.values()}


def alone(part, features, parts, least, depth=None):
    """Fits of one group, its features scaled within it."""
    n = part.count()
    if n < parts * least:
        return {frozenset(r.i for r in part.select("i").collect())}
    model = Partitioner(target="sum", min_gain=0.0, n_partitions=min(parts, n // least), min_samples_leaf=least, max_depth=depth).fit(part, features, ["i"])
    return groups(model.transform(part))


def test_anchored(spark, df):
    got = groups(compose.anchored(df, ["a", "b"], ["c", "d", "e"], 4, 3, 120))
    want = set()
    for rows in alone(df, ["a", "b"], 4, 120):
        want |= alone(df.where(df.i.isin(*rows)), ["c", "d", "e"], 3, 120)
    assert got == want and any(len(x) < 240 for x in got)


def test_many_rounds(spark, df):
    got = groups(compose.many_rounds(df, ["a", "b"], ["c", "d"], 3, 2, 200, 1))
    current = alone(df, ["a", "b"], 2, 200, 1)
    for _ in range(2):
        current = {x for rows in current for x in alone(df.where(df.i.isin(*rows)), ["c", "d"], 2, 200, 1)}
    assert got == current and 4 < len(got) <= 8
    assert groups(compose.many_rounds(df, ["a"], ["c"], 0, 2)) == {frozenset(range(2000))}


def test_hierarchical_is_refined(spark, df):
    coarse = Partitioner(target="sum", min_gain=0.0, n_partitions=3).fit(df, ["a", "b"], ["i"])
    fine = Partitioner(target="sum", min_gain=0.0, n_partitions=4, min_samples_leaf=20)
    want = set()
    for rows in groups(coarse.transform(df)):
        want |= alone(df.where(df.i.isin(*rows)), ["c", "d"], 4, 20)
    assert groups(compose.hierarchical(df, coarse, fine, ["c", "d"])) == want


def test_jobs_do_not_grow_with_the_groups(spark, df, monkeypatch):
    monkeypatch.setattr(tree, "LOCAL_CELLS", 0)
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for n in (2, 40):
        given = df.selectExpr("*", f"cast(i % {n} as int) as g")
        spark.sparkContext.setJobGroup(f"refine-{n}", "")
        compose.refined(given, "g", ["a", "b"], 2, 5, 1).count()
        jobs[n] = len(tracker.getJobIdsForGroup(f"refine-{n}"))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[40] <= jobs[2] + 1


def test_odd_groups(spark, df):
    assert compose.refined(df.limit(0).selectExpr("*", "0 as g"), "g", ["a"], 2).count() == 0
    with pytest.raises(ValueError):
        compose.refined(df.selectExpr("*", "cast(null as int) as g"), "g", ["a"], 2)
    constant = compose.refined(df.selectExpr("*", "cast(i % 2 as int) as g", "1.0 as one"), "g", ["one"], 2)
    assert groups(constant) == {frozenset(range(0, 2000, 2)), frozenset(range(1, 2000, 2))}


def test_novelty_of_an_expansion(spark, df):
    model = Partitioner(min_gain=0.0, n_partitions=5).fit(df, ["a", "b", "c"], ["i"])
    made, stats = model.expand(200, return_novelty_stats=True)
    far = [r.distance for r in model.compute_novelty(made, ["partition_id", "synthetic_id"]).collect()]
    assert made.count() == 200 and set(stats) == {"min", "mean", "p5"} and 0 <= stats["min"] <= stats["p5"] <= stats["mean"]
    assert abs(stats["min"] - min(far)) < 1e-9 and abs(stats["mean"] - sum(far) / 200) < 1e-9
    assert model.expand(50).count() == 50


def test_too_many_orthants(spark, df, monkeypatch):
    from varileaf.operators import select

    picked = select.orthants(df, ["i"], ["a", "b", "c"], "d", 30)
    assert picked.count() == 30
    monkeypatch.setattr(select, "MOST_ORTHANTS", 3)
    with pytest.raises(ValueError):
        select.orthants(df, ["i"], ["a", "b", "c"], "d", 30)
