"""The engine against brute force, closed forms and properties."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from varileaf import queries
from varileaf.functions import draws
from varileaf.operators import baselines, budgets, generate, metrics, select, tree
from varileaf.plans import compose
from varileaf.plans.model import PRESETS, Partitioner
from varileaf.sources import datasets, tables
from varileaf.streaming.windows import partition_windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return datasets.multimodal(spark, 600).cache()


@pytest.fixture(scope="module")
def model(data):
    return Partitioner(min_gain=0.0, n_partitions=8, min_samples_leaf=10).fit(data, ["f1", "f2", "f3", "f4"], ["row_id"])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in ("lineitem", "orders", "part", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_tree_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((120, 2)), 1)
    t = np.where(x[:, 0] > 0.3, 2.0, 0.0) + x[:, 1] ** 2
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, t)], "a double, b double, t double")
    grown = tree.grow(df, ["a", "b"], "t", 6, 5)

    def best(rows):
        out = (0.0, None)
        for f in range(2):
            v = np.unique(x[rows, f])
            for c in (v[1:] + v[:-1]) / 2:
                left = x[rows, f] <= c
                if 5 <= left.sum() <= len(rows) - 5:
                    gain = sum(((t[r] - t[r].mean()) ** 2).sum() * s for r, s in ((rows, 1), (rows[left], -1), (rows[~left], -1)))
                    if gain > out[0] + 1e-9:
                        out = (gain, (f, c))
        return out

    leaves = [np.arange(120)]
    while len(leaves) < 6:
        gains = [best(r) for r in leaves]
        at = max(range(len(leaves)), key=lambda i: gains[i][0])
        rows, (f, c) = leaves.pop(at), gains[at][1]
        leaves += [rows[x[rows, f] <= c], rows[x[rows, f] > c]]
    got = df.select(tree.Tree.leaf(grown).alias("p")).groupBy("p").count().collect()
    assert sorted(r["count"] for r in got) == sorted(map(len, leaves))
    assert abs(sum(grown.importances.values()) - 1) < 1e-9


def test_distributed_tree_equals_local(spark, data, monkeypatch):
    for criterion in ("squared_error", "absolute_error"):
        a = tree.grow(data, ["f1", "f2"], "y", 8, 10, criterion=criterion)
        monkeypatch.setattr(tree, "LOCAL_CELLS", 0)
        b = tree.grow(data, ["f1", "f2"], "y", 8, 10, criterion=criterion)
        monkeypatch.undo()
        assert [(x.feature, x.threshold, x.n) for x in a.nodes] == [(x.feature, x.threshold, x.n) for x in b.nodes]


def test_tree_round_trip(spark, tmp_path, model, data):
    model.tree.save(spark, str(tmp_path / "t"))
    assert tree.Tree.load(spark, str(tmp_path / "t")).to_json() == model.tree.to_json()


def test_budgets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(1, 50, 6)
        n = int(rng.integers(1, sizes.sum() + 1))
        want = np.maximum(2, (sizes / sizes.sum() * n).astype(int))
        while want.sum() > n:
            want[want.argmax()] -= 1
        while want.sum() < n:
            want[want.argmin()] += 1
        assert budgets.allocate(budgets.weights(sizes), n, 2).tolist() == want.tolist()
        b = budgets.for_reduction(budgets.weights(sizes, rng.random(6)), sizes, n)
        assert b.sum() == n and (b <= sizes).all() and (budgets.largest_remainder(rng.random(6), n, sizes) <= sizes).all()
    assert budgets.from_ratio(100, ratio=0.29) == 28
    with pytest.raises(ValueError):
        budgets.from_ratio(10)


@pytest.mark.parametrize("method", ["fps", "medoid_fps", "variance_ordered", "stratified", "mixed_fps", lambda z, b, s: np.arange(b)])
def test_reduce(model, data, method):
    out = model.reduce(n=60, method=method)
    assert out.count() == 60 == out.select("row_id").distinct().count()
    assert compose.fingerprint(out) == compose.fingerprint(model.reduce(n=60, method=method))


@pytest.mark.parametrize("name", [*generate.EXPRESSIONS, *generate.KERNELS])
def test_expand(model, data, name):
    out = model.expand(200, generation_strategy=name)
    row = out.agg(F.count(F.lit(1)).alias("n"), F.count("f1").alias("f"), F.max(F.abs("f1")).alias("m")).first()
    assert (row.n, row.f) == (200, 200) and row.m < 50


def test_augment_and_novelty(model, data):
    out = model.augment(900)
    assert out.count() == 900 and out.where("is_synthetic").count() == 300
    assert model.compute_novelty(data, ["row_id"]).agg(F.max("distance")).first()[0] < 1e-6
    stats = model.geometry_stats()
    assert stats["n_samples"] == 600 and sum(p["n"] for p in stats["partitions"]) == 600
    with pytest.raises(ValueError):
        model.augment(10)


def test_presets_and_warning(data):
    for p in PRESETS.values():
        assert p.set_params(min_gain=0.0, n_partitions=6).fit(data, ["f1", "f2"], ["row_id"], y="y").n_partitions > 1
    with pytest.warns(UserWarning, match="one partition"):
        PRESETS["pairwise"].set_params(min_gain=1e9).fit(data, ["f1", "f2"], ["row_id"])
    assert tree.tuned(1000, 5, True) == (30, 133)


def test_metrics(data):
    f = ["f1", "f2"]
    assert metrics.marginal_fidelity(data, data, f) == pytest.approx(1) and metrics.correlation_fidelity(data, data, f) == pytest.approx(1)
    assert metrics.tail_preservation(data, data, f) == pytest.approx(1)
    far = data.select("row_id", *[(F.col(c) + 100).alias(c) for c in f])
    assert metrics.privacy_dcr(data, far, f, ["row_id"]) > 10 and metrics.discriminator_accuracy(data, far, f) > 0.95


def test_baselines(data):
    f = ["f1", "f2"]
    for out in (baselines.random_rows(data, ["row_id"], 30), baselines.kennard_stone(data, ["row_id"], f, 30), baselines.pivoted_qr(data, ["row_id"], f, 30)):
        assert out.count() == 30
    assert 55 <= baselines.stratified_rows(data, ["row_id"], "y", 0.1).count() <= 70


def test_compose(spark, data, model):
    left, errors = compose.residual_rounds(data, ["f1", "f2"], ["row_id"], (4, 8))
    assert errors[1] <= errors[0] and left.count() == 600
    marked = model.transform(data)
    fitted = compose.predict_linear(marked, compose.linear_models(marked, ["f1", "f2", "f3"], "y"), ["f1", "f2", "f3"])
    assert fitted.agg(F.avg((F.col("y") - F.col("prediction")) ** 2) < F.var_pop("y")).first()[0]
    search = compose.Search(n_trials=3, objective=lambda p: -p["y_weight"])
    assert search.run(data, ["f1", "f2"], ["row_id"]).n_partitions > 1 and search.best_score == 0


def test_datasets_and_results(spark, tmp_path):
    for make in datasets.DATASETS.values():
        df = make(spark, 50)
        assert df.count() == 50 and df.agg(*[F.count(c) for c in df.columns]).first()[0] == 50
    res = spark.createDataFrame([("t", "d", "m", {"r": 0.1}, {"auc": 0.5}, "now")], tables.RESULT)
    tables.write_results(res, str(tmp_path / "r"))
    assert "0.5000" in tables.results_table(tables.read_results(spark, str(tmp_path / "r")), "t", "auc")


def test_stream(spark, model, data, tmp_path):
    data.select("row_id", "f1", "f2", "f3", "f4", F.timestamp_seconds(F.col("row_id") * 60).alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = partition_windows(model.transform(stream), "ts", "f1", "1 hour", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == 600


def test_quantile_functions(spark):
    row = spark.range(1).select(draws.probit(F.lit(0.975)), draws.epanechnikov_quantile(F.lit(0.5)), draws.laplace_quantile(F.lit(0.5))).first()
    assert abs(row[0] - 1.96) < 0.01 and abs(row[1]) < 1e-12 and abs(row[2]) < 1e-12


def test_orthants_are_linearly_spaced(spark):
    df = spark.createDataFrame([(i, float(i % 7) - 3, float(i)) for i in range(70)], "id long, z double, y double")
    assert select.orthants(df, ["id"], ["z"], "y", 20).count() == 20


def test_novelty_is_refused_where_it_has_no_effect(spark):
    from varileaf.operators import generate

    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), i % 2) for i in range(60)], "id long, z_a double, z_b double, partition_id int")
    with pytest.raises(ValueError):
        generate.generate(df, ["id"], ["z_a", "z_b"], {0: 5, 1: 5}, "epanechnikov", novelty=0.5)
    made = generate.generate(df, ["id"], ["z_a", "z_b"], {0: 5, 1: 5}, "independent_kde", novelty=0.5)
    assert made.count() == 10


def test_hashed_numbers_fill_the_unit_interval(spark):
    from pyspark.sql import functions as F

    from varileaf.functions import draws

    row = spark.range(4000).select(draws.uniform(1, F.col("id")).alias("u"), draws.normal(1, F.col("id")).alias("n"), draws.epanechnikov(1, F.col("id")).alias("e")).agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("n"), F.stddev("n"), F.min("e"), F.max("e"), F.var_pop("e")).first()
    assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.02
    assert abs(row[3]) < 0.06 and abs(row[4] - 1) < 0.05 and row[5] > -1 and row[6] < 1 and abs(row[7] - 0.2) < 0.02


def test_statistics_of_one_partition_and_ties(spark):
    from varileaf.operators import metrics

    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.5), (1, "a", 0.25)], "partition_id int, label string, p double")
    assert [(r.partition_id, r.label, r.place) for r in metrics.composition(df, "label").orderBy("partition_id", "place").collect()] == [(0, "a", 1), (0, "b", 2), (1, "a", 1)]
    assert metrics.weighted_purity(df, "label").first().purity == pytest.approx(2 / 3)
    assert {(r.label, r.wins) for r in metrics.wins(df, "p", "higher", "partition_id", "label").collect()} == {("a", 2), ("b", 0)}
    assert {(r.place, r.heat) for r in metrics.ranks(df, "p", "half", "partition_id", "label").collect()} == {(1, 1.0), (2, 0.0)}
    assert metrics.at_risk(df, 2).first()[:] == (1.0, 0.5)
