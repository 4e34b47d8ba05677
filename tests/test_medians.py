"""Exact medians by counting around the middle, areas from counts, and histograms that a task adds up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varileaf.operators import metrics, scaling, tree


@pytest.mark.parametrize("most", [scaling.MIDDLE_ROWS, 50])
def test_medians(spark, monkeypatch, most):
    monkeypatch.setattr(scaling, "MIDDLE_ROWS", most)
    rng = np.random.default_rng(8)
    odd = [float(v) for v in rng.normal(size=1001)]
    given = {"odd": odd, "even": [*odd[1:], None], "two": [1.0] * 500 + [2.0] * 500 + [None], "nan": [float("nan")] * 400 + odd[:601], "most": [float("nan")] * 600 + odd[:401], "none": [None] * 1001}
    df = spark.createDataFrame(list(zip(*given.values(), strict=True)), ", ".join(f"{k} double" for k in given)).repartition(2).cache()
    got = scaling.medians(df, [F.col(c) for c in given])
    assert repr(got) == repr(list(df.agg(*[F.median(c) for c in given]).first()))


def test_scaler_sorts_no_column_in_one_task(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("an aggregate that holds all distinct values in one task")

    monkeypatch.setattr(F, "median", refused)
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    s = scaling.Scaler(["x"], "mad").fit(df)
    assert (s.center["x"], s.scale["x"]) == (500.0, scaling.MAD_FACTOR * 250)


def test_privacy_counts_distances(spark, monkeypatch):
    monkeypatch.setattr(F, "median", lambda *_: pytest.fail("an aggregate that holds all distinct values in one task"))
    real = spark.createDataFrame([(i, float(i)) for i in range(9)], "id long, x double")
    made = spark.createDataFrame([(i, i + 0.25) for i in range(9)], "id long, x double")
    assert metrics.privacy_dcr(real, made, ["x"], ["id"]) == 0.25


def test_areas_count_each_score_before_they_are_ranked(spark):
    rows = [(k, float(i % 7), float(i % 3)) for i, k in enumerate("ABBACABCA" * 5)]
    df = spark.createDataFrame(rows, "l string, x double, y double")
    found = metrics.auc(df, "l", {"A": "x", "B": "y"})
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        own, other = ([v[1 if r["class"] == "A" else 2] for v in rows if (v[0] == r["class"]) is k] for k in (True, False))
        assert r.auc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in own for b in other]))


def test_a_task_sends_a_cell_once(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 5).cast("double").alias("t")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    monkeypatch.setattr(tree, "LOCAL_CELLS", 0)
    try:
        cuts = tree.edges(df, ["a", "b"])
        source = tree._Source(df, ["a", "b"], "t", [cuts], None, 4000)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        sent = []
        own = type(source.table)
        run = own.mapInArrow
        monkeypatch.setattr(own, "mapInArrow", lambda self, *x: sent.append(out := run(self, *x)) or out)
        h = source.levels((np.array([-1]), np.array([0]), np.array([-1]), np.array([-1])), [0], 1)
        assert sent[0].count() == 13 + 7
        assert h[0, 0, :13, 0, 0].sum() == h[0, 1, :7, 0, 0].sum() == 4000
        source.close()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
