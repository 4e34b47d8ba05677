"""Copulas, independent features and rank-sum areas against plain numpy, in partitions of any size and with ties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varileaf.functions import draws
from varileaf.operators import generate, marginals, metrics

Z = ["z_a", "z_b", "z_c"]


def rows_of(seed=1):
    rng = random.Random(seed)
    out = []
    for p, n in ((0, 2500), (1, 40), (2, 2), (3, 1)):
        for _ in range(n):
            a = rng.gauss(0, 1)
            out.append((len(out), a, float(rng.randint(0, 3)) + (a > 0), -a + rng.gauss(0, 0.5), p))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows_of(), "id int, z_a double, z_b double, z_c double, partition_id int").cache()


def own(p):
    return np.array([r[1:4] for r in rows_of() if r[4] == p])


def test_the_normal_distribution_function(spark):
    x = [-8.0, -4.7, -1.0, -1e-9, 0.0, 0.3, 2.5, 6.5]
    found = [r.u for r in spark.createDataFrame([(v,) for v in x], "x double").select(draws.normal_share(F.col("x")).alias("u")).collect()]
    assert np.allclose(found[1:], [0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x[1:]], atol=1e-14) and 0 < found[0] < 2e-12


def test_ranks_and_grid_are_numpys(df):
    placed = marginals.ranks(df, Z)
    found = {}
    for r in marginals.grid(placed).collect():
        found.setdefault((r.partition_id, r["_j"]), {})[r["_g"]] = (r["_low"], r["_high"])
    for p in range(4):
        for j in range(3):
            points = np.quantile(own(p)[:, j], np.arange(marginals.GRID) / (marginals.GRID - 1))
            got = found[p, j]
            assert sorted(got) == list(range(marginals.GRID - 1))
            assert np.allclose([got[k][0] for k in sorted(got)], points[:-1]) and np.allclose([got[k][1] for k in sorted(got)], points[1:])
    for r in placed.where("partition_id = 0 and _j = 1").collect():
        x = own(0)[:, 1]
        assert (r["_k"], r["_below__k"], r["_all__k"]) == ((x == r["_x"]).sum(), (x < r["_x"]).sum(), 2500)


def test_factors_are_the_scores_correlations(df):
    found = {r["_pid"]: np.array(r["_chol"]).reshape(3, 3) for r in marginals.factors(df, ["id"], Z, marginals.ranks(df, Z)).collect()}
    for p in (0, 1):
        x = own(p)
        mean_rank = np.column_stack([[(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c] for c in x.T]) / (len(x) + 1)
        k = 2 / (math.pi * 0.147) + np.log(1 - (2 * mean_rank - 1) ** 2) / 2
        score = math.sqrt(2) * np.sign(2 * mean_rank - 1) * np.sqrt(np.sqrt(k * k - np.log(1 - (2 * mean_rank - 1) ** 2) / 0.147) - k)
        assert np.allclose(found[p] @ found[p].T, np.corrcoef(score, rowvar=False), atol=1e-6)
    assert np.allclose(found[2], np.eye(3)) and np.allclose(found[3], np.eye(3))


@pytest.mark.parametrize("name", generate.BY_FEATURE)
def test_every_partition_gets_its_rows(df, monkeypatch, name):
    budget = {0: 700, 1: 50, 2: 5, 3: 4, 9: 0}
    made = generate.generate(df, ["id"], Z, budget, name, seed=3).toPandas()
    assert made.groupby("partition_id").size().to_dict() == {0: 700, 1: 50, 2: 5, 3: 4} and not made.isna().any().any()
    assert sorted(made.loc[made.partition_id == 0, "synthetic_id"]) == list(range(700))
    if name != "independent_kde":
        x = made.loc[made.partition_id == 0, Z].to_numpy()
        assert (x >= own(0).min(0)).all() and (x <= own(0).max(0)).all()
        if name == "univariate_kde_copula":  # lattice numbers of two features are themselves related
            assert abs(np.corrcoef(x, rowvar=False) - np.corrcoef(own(0), rowvar=False)).max() < 0.12
    assert np.allclose(made.loc[made.partition_id == 3, Z], own(3)[0])
    spread = generate.generate(df.repartition(7), ["id"], Z, budget, name, seed=3).toPandas()
    keys = ["partition_id", "synthetic_id"]
    assert np.allclose(made.sort_values(keys)[Z], spread.sort_values(keys)[Z])  # the layout doesn't matter


def test_areas_count_ties_half(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), float(rng.randint(0, 9)), rng.random(), 1.0) for _ in range(300)] + [(None, 1.0, 1.0, 1.0), ("a", None, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, flat double")
    found = {r["class"]: r for r in metrics.auc(df, "k", {"a": "x", "b": "y", "c": "flat", "none": "x"}).collect()}
    for k, at in (("a", 1), ("b", 2), ("c", 3)):
        inside, outside = [r[at] for r in rows if r[0] == k and r[at] is not None], [r[at] for r in rows if r[0] not in (k, None) and r[at] is not None]
        share = sum((p > q) + 0.5 * (p == q) for p in inside for q in outside) / (len(inside) * len(outside))
        assert abs(found[k].auc - share) < 1e-12 and found[k].positives == len(inside)
    assert found["none"].auc is None and found["none"].positives == 0
    assert metrics.auc(df.limit(0), "k", {"a": "x"}).count() == 0


def test_what_a_reduced_table_explains(spark):
    rng = random.Random(5)

    def made(n, classes):
        x = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(n)]
        return spark.createDataFrame([(a, b, float(3 * (a > 0) if classes == 2 else 2 * (a > 0) + (b > 0.5))) for a, b in x], "a double, b double, y double").cache()

    for classes in (2, 4):
        full, small, test = made(300, classes), made(60, classes), made(200, classes)
        out = metrics.error_explanation(full, small, test, ["a", "b"], "y", 4)
        assert list(out) == ["n_errors", "coverage_rate", "error_set_auc", "full_trtr_auc", "full_tstr_auc"]
        assert 0 <= out["n_errors"] < 40 and 0 <= out["coverage_rate"] <= 1 and 0.9 < out["full_trtr_auc"] <= 1 and 0.8 < out["full_tstr_auc"] <= 1
        assert metrics.learned(full, test, ["a", "b"], "y", "auc", 4) == pytest.approx(out["full_trtr_auc"])
        assert metrics.learned(full, test, ["a", "b"], "y", trees=4) > 0.85
    assert math.isnan(metrics.error_explanation(full.withColumn("y", F.lit(1.0)), small, test, ["a", "b"], "y")["n_errors"])


def test_failures_are_counted_and_replaced(spark):
    def cholesky(z, budget, seed):  # fails on partitions without spread
        return z.mean(0) + np.random.default_rng(seed).standard_normal((budget, z.shape[1])) @ np.linalg.cholesky(np.cov(z, rowvar=False)).T

    rng = random.Random(6)
    rows = [(i, p, *((rng.gauss(0, 1), rng.gauss(0, 1)) if p == 0 else (2.0, -1.0))) for i, p in enumerate([0] * 40 + [1] * 10 + [2])]
    df = spark.createDataFrame(rows, "id int, partition_id int, z_a double, z_b double").cache()
    budget = {0: 30, 1: 20, 2: 5}
    made = generate.generate(df, ["id"], ["z_a", "z_b"], budget, cholesky, fallback=True).toPandas()
    assert made.groupby("partition_id").size().to_dict() == budget
    assert made[made.failed].partition_id.unique().tolist() == [1] and made.failed.sum() == 20  # the single row isn't a failure
    off = made[made.partition_id > 0]
    assert (abs(off.z_a - 2) < 0.5).all() and (abs(off.z_b + 1) < 0.5).all() and off.z_a.std() > 0
    none = generate.guarded(lambda z, budget, seed: np.full((budget, 2), np.nan), np.ones((3, 2)), 4, 1)
    short = generate.guarded(lambda z, budget, seed: z[:1], np.ones((3, 2)), 4, 1)
    assert none[1] and short[1] and none[0].shape == short[0].shape == (4, 2)
    for name in ("epanechnikov", "lattice_copula"):
        assert generate.generate(df, ["id"], ["z_a", "z_b"], {0: 3}, name, fallback=True).where("not failed").count() == 3
    with pytest.raises(Exception, match="(?i)positive definite"):
        generate.generate(df, ["id"], ["z_a", "z_b"], budget, cholesky).collect()
