"""Generated tables. Each row's values depend on its row_id and the seed alone, so any layout gives the same table."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varileaf.functions import draws

ID = "row_id"


def _u(seed: int, k: int) -> Column:
    return draws.uniform(seed, F.col(ID), k)


def _n(seed: int, k: int) -> Column:
    return draws.normal(seed, F.col(ID), k)


def _rows(spark: SparkSession, n: int, columns: dict[str, Column]) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id").select("row_id", *[c.alias(k) for k, c in columns.items()])


def _label(df: DataFrame, odds: Column) -> DataFrame:
    return df.withColumn("y", (draws.uniform(97, F.col(ID)) < 1 / (1 + F.exp(-odds))).cast("int"))


def adult_like(spark: SparkSession, n: int = 20_000, seed: int = 42) -> DataFrame:
    """Census-like: eight numeric columns and a binary label."""
    clip = lambda c, a, b: F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), c))
    df = _rows(spark, n, {
        "age": clip(38 + 13 * _n(seed, 1), 17, 90), "education_num": clip(F.round(10 + 2.5 * _n(seed, 2)), 1, 16), "hours_per_week": clip(40 + 12 * _n(seed, 3), 1, 99),
        "capital_gain": F.when(_u(seed, 4) < 0.08, F.exp(8 + _n(seed, 5))).otherwise(0.0), "capital_loss": F.when(_u(seed, 6) < 0.05, F.exp(7 + 0.3 * _n(seed, 7))).otherwise(0.0),
        "fnlwgt": F.exp(12 + 0.5 * _n(seed, 8)), "relationship": F.floor(6 * _u(seed, 9)).cast("double"), "marital_status": F.floor(7 * _u(seed, 10)).cast("double"),
    })
    return _label(df, -8 + 0.03 * F.col("age") + 0.35 * F.col("education_num") + 0.03 * F.col("hours_per_week") + F.col("capital_gain") / 5000)


def fraud_like(spark: SparkSession, n: int = 20_000, seed: int = 42) -> DataFrame:
    """Fifteen columns; 3 % positives in three shifted clusters."""
    y, cluster = _u(seed, 100) < 0.03, F.floor(3 * _u(seed, 101))
    shared = _n(seed, 102)
    values = {f"v{j + 1}": 0.4 * shared + 0.9 * _n(seed, j) + F.when(y, 2.5 * F.cos(cluster * 2 + j)).otherwise(0.0) for j in range(15)}
    return _rows(spark, n, {**values, "y": y.cast("int")})


def housing_like(spark: SparkSession, n: int = 20_000, seed: int = 42) -> DataFrame:
    """Six log-normal columns and a log-linear price."""
    shape = {"sqft": (7.3, 0.4), "lot_size": (8.7, 0.6), "rooms": (1.8, 0.25), "age": (3.0, 0.7), "distance_cbd": (2.0, 0.6), "neighbourhood_income": (10.9, 0.4)}
    df = _rows(spark, n, {c: F.exp(m + s * _n(seed, k)) for k, (c, (m, s)) in enumerate(shape.items())})
    log = 0.7 * F.log("sqft") + 0.1 * F.log("lot_size") - 0.1 * F.log("age") - 0.2 * F.log("distance_cbd") + 0.5 * F.log("neighbourhood_income")
    return df.withColumn("y", F.exp(log + 0.15 * _n(seed, 50)))


def multimodal(spark: SparkSession, n: int = 20_000, seed: int = 42) -> DataFrame:
    """Ten columns in three clusters of 50, 30 and 20 %."""
    u = _u(seed, 100)
    k = F.when(u < 0.5, 0).when(u < 0.8, 1).otherwise(2)
    df = _rows(spark, n, {f"f{j + 1}": 3 * F.sin(k * (j + 1)) + (0.5 + 0.3 * k) * _n(seed, j) for j in range(10)})
    return df.withColumn("y", F.col("f1") * F.col("f2") + F.col("f3") + 0.3 * _n(seed, 60))


def _five(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return _rows(spark, n, {f"f{j + 1}": _n(seed, j) for j in range(5)})


def emergence_divergence(spark: SparkSession, n: int = 10_000, seed: int = 42) -> DataFrame:
    """A product of two columns matters only above a level."""
    product = F.col("f1") * F.col("f2")
    return _five(spark, n, seed).withColumn("y", F.col("f3") + F.when(product > 1.5, 5 * product).otherwise(0.0) + 0.1 * _n(seed, 50))


def emergence_bifurcation(spark: SparkSession, n: int = 10_000, seed: int = 42) -> DataFrame:
    """Beyond a level the label goes one way or the other by a second column's sign."""
    far = F.abs("f1")
    return _five(spark, n, seed).withColumn("y", F.col("f3") + F.when(far > 1.5, 4 * far * F.signum("f2")).otherwise(0.0) + 0.1 * _n(seed, 50))


def _study(kind: str) -> Callable[..., DataFrame]:
    def make(spark: SparkSession, n: int = 5_000, seed: int = 42) -> DataFrame:
        heavy, d = kind in ("heavy_tail", "noisy_all"), 20 if kind == "noisy_all" else 10
        # Student's t with two degrees of freedom: a normal over the root of an exponential
        x = {f"f{j}": _n(seed, j) / F.sqrt(-F.log(1 - _u(seed, 200 + j))) if heavy else _n(seed, j) for j in range(d)}
        df = _rows(spark, n, x)
        odds = F.col("f0") + F.col("f1") * F.col("f2")
        y = (odds > (2.6 if kind == "rare_events" else 0.0)).cast("int")
        flip = 0.2 if kind.startswith("noisy") else 0.0
        return df.withColumn("y", F.when(draws.uniform(seed + 7, F.col(ID)) < flip, 1 - y).otherwise(y))

    make.__name__ = kind
    return make


def correlated_modes(spark: SparkSession, n: int = 500, d: int = 5, seed: int = 42) -> DataFrame:
    """Three modes of correlated normals."""
    k = F.floor(3 * _u(seed, 300))
    return _rows(spark, n, {f"f{j}": 3 * (k - 1) + 0.6 * _n(seed, 301) + 0.8 * _n(seed, j) for j in range(d)})


def cauchy_rare(spark: SparkSession, n: int = 5_000, seed: int = 42) -> DataFrame:
    """Clipped Cauchy noise, with 5 % of rows ten times as large."""
    scale = F.when(_u(seed, 300) < 0.05, 10.0).otherwise(1.0)
    noise = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.tan(math.pi * (_u(seed, 301) - 0.5))))
    df = _rows(spark, n, {f"f{j}": scale * _n(seed, j) for j in range(5)})
    return df.withColumn("y", F.col("f0") + 0.5 * F.col("f1") + noise)


def sine_curve(spark: SparkSession, n: int = 150, seed: int = 42) -> DataFrame:
    x = 2 * math.pi * _u(seed, 1)
    return _rows(spark, n, {"x1": x, "x2": F.sin(x) + 0.05 * _n(seed, 2)})


def clipped_normal(spark: SparkSession, n: int = 200, seed: int = 42) -> DataFrame:
    return _rows(spark, n, {f"f{j}": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _n(seed, j))) for j in range(5)})


def noisy_ring(spark: SparkSession, n: int = 20, seed: int = 42) -> DataFrame:
    a = 2 * math.pi * _u(seed, 1)
    return _rows(spark, n, {"x1": F.cos(a) + 0.05 * _n(seed, 2), "x2": F.sin(a) + 0.05 * _n(seed, 3)})


DATASETS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (adult_like, fraud_like, housing_like, multimodal, emergence_divergence, emergence_bifurcation, correlated_modes, cauchy_rare, sine_curve, clipped_normal, noisy_ring, *map(_study, ("well_behaved", "heavy_tail", "noisy_labels", "noisy_all", "rare_events")))
}


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("row_id", "y")]
