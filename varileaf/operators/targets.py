"""Row-wise targets that the partitioning tree splits on: each fit returns one column with its statistics as literals."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varileaf.functions import geometry as g
from varileaf.operators.scaling import MAD_FACTOR, medians

#: Up to so many features the pair moments are one SQL aggregation; beyond, Arrow batches add matrices.
SQL_FEATURES = 24
EPS = 1e-10


def standardised(df: DataFrame, x: Column, eps: float = 0.0, least: float = 0.0) -> Column:
    """(x - mean) / population deviation; a deviation of `least` or below counts as 1."""
    row = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).first()
    m, s = float(row.m or 0.0), float(row.s or 0.0)
    return (x - F.lit(m)) / F.lit(s + eps if eps else (s if s > least else 1.0))


def robust(df: DataFrame, x: Column, eps: float = EPS, exact: bool = True) -> Column:
    m = float(medians(df, [x], exact)[0] or 0.0)
    mad = float(medians(df, [F.abs(x - F.lit(m))], exact)[0] or 0.0)
    return (x - F.lit(m)) / F.lit(MAD_FACTOR * mad + eps)


def pair_moments(df: DataFrame, z: list[str]) -> dict[tuple[int, int], tuple[float, float]]:
    """Mean and population deviation of every pairwise product, in one pass."""
    pairs = list(combinations(range(len(z)), 2))
    if not pairs:
        return {}
    if len(z) <= SQL_FEATURES:
        product = {p: F.col(f"`{z[p[0]]}`") * F.col(f"`{z[p[1]]}`") for p in pairs}
        row = df.agg(*[F.avg(product[p]) for p in pairs], *[F.stddev_pop(product[p]) for p in pairs]).first()
        return {p: (float(row[i] or 0.0), float(row[i + len(pairs)] or 0.0)) for i, p in enumerate(pairs)}
    d = len(z)

    def sums(frames):
        first, second, n = np.zeros((d, d)), np.zeros((d, d)), 0
        for frame in frames:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in frame.columns])
            first += x.T @ x
            second += (x * x).T @ (x * x)
            n += len(x)
        for i in range(d):
            yield pa.RecordBatch.from_arrays([pa.array([i] * d), pa.array(range(d)), pa.array([n] * d), pa.array(first[i]), pa.array(second[i])], names=["i", "j", "n", "a", "b"])

    rows = df.select(*[F.col(f"`{c}`") for c in z]).mapInArrow(sums, "i long, j long, n long, a double, b double").where("i < j").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return {(r.i, r.j): (r.a / r.n, max(0.0, r.b / r.n - (r.a / r.n) ** 2) ** 0.5) for r in rows if r.n}


def pairwise(df: DataFrame, z: list[str]) -> Column:
    """Sum over pairs of the standardised product; pairs without spread add nothing."""
    terms, shift = [], 0.0
    for (i, j), (m, s) in sorted(pair_moments(df, z).items()):
        if s > EPS:
            terms.append(F.col(f"`{z[i]}`") * F.col(f"`{z[j]}`") * F.lit(1 / s))
            shift += m / s
    return g.total(terms) - F.lit(shift)


def selective(df: DataFrame, z: list[str], residual: Column, k: int | None = None) -> Column:
    """The k pairs whose product correlates most with a residual, standardised and summed, then standardised.

    All pairs give the pairwise target; no pair gives the standardised residual.
    """
    pairs = list(combinations(z, 2))
    k = max(5, len(pairs) // 4) if k is None else k
    if not pairs or k <= 0:
        return standardised(df, residual)
    product = [F.col(f"`{a}`") * F.col(f"`{b}`") for a, b in pairs]
    row = df.agg(*[F.corr(p, residual) for p in product], *[F.avg(p) for p in product], *[F.stddev_pop(p) for p in product]).first()
    n = len(pairs)
    order = sorted(range(n), key=lambda i: (-abs(row[i] if row[i] is not None and row[i] == row[i] else 0.0), i))[: min(k, n)]
    terms = [(product[i] - F.lit(float(row[n + i]))) / F.lit(float(row[2 * n + i])) for i in sorted(order) if row[2 * n + i] > EPS]
    return standardised(df, g.total(terms))


#: Names of the geometric targets; those marked true are standardised afterwards.
KINDS = {
    "pairwise": False, "sum": False, "l1": False, "l1_norm": False,
    "pairwise_z": True, "sum_z": True, "l1_z": True, "abs_pairwise": True, "e3": True,
}


def geometric(df: DataFrame, z: list[str], kind: str) -> Column:
    """The target of that name over the z columns of df."""
    if kind not in KINDS:
        raise ValueError(f"unknown target {kind!r}, expected one of {sorted(KINDS)}")
    c = [F.col(f"`{x}`") for x in z]
    base = {
        "pairwise": lambda: pairwise(df, z),
        "sum": lambda: g.signed_sum(c),
        "l1": lambda: g.sign_deficit(c),
        "l1_norm": lambda: g.total([F.abs(x) for x in c]),
        "abs_pairwise": lambda: g.magnitude_products(c),
        "e3": lambda: g.third_symmetric(c),
    }[kind.removesuffix("_z")]()
    return standardised(df, base) if KINDS[kind] else base


def extremeness(df: DataFrame, y: Column, scaling: str = "std", exact: bool = True) -> tuple[Column, Column]:
    """The standardised distance of y from its median, and the distance itself in units of the std-scaled y."""
    normal = standardised(df, y, eps=EPS)
    m = float(medians(df, [normal], exact)[0] or 0.0)
    far = F.abs(normal - F.lit(m))
    if scaling == "std":
        return standardised(df, far, eps=EPS), far
    own = robust(df, y, exact=exact)
    m = float(medians(df, [own], exact)[0] or 0.0)
    return robust(df, F.abs(own - F.lit(m)), exact=exact), far


def blend(df: DataFrame, x: Column, y: Column, weight: float, mode: str = "fixed", scaling: str = "std", exact: bool = True) -> Column:
    """Geometry and label: a fixed weight, one that falls with their correlation, one that rises with a row's extremeness, or both."""
    if mode not in ("fixed", "adaptive", "linear", "adaptive_linear"):
        raise ValueError(f"unknown y_weight_mode {mode!r}")
    if not weight:
        return x
    label, far = extremeness(df, y, scaling, exact)
    w = F.lit(float(weight))
    if mode.startswith("adaptive"):
        r = df.agg(F.corr(x, label)).first()[0]
        w = w * F.lit(1 - abs(r if r is not None and r == r else 0.0))
    if mode.endswith("linear"):
        top = float(df.agg(F.max(far)).first()[0] or 0.0)
        w = w * far / F.lit(top + EPS)
    return (1 - w) * x + w * label


def blend_scaled(df: DataFrame, x: Column, y: Column, weight: float, cross: bool = False) -> Column:
    """The other profile of blending: y scaled to [0, 1], its distance from the median standardised; optionally the standardised product too."""
    low, high = df.agg(F.min(y), F.max(y)).first()
    unit = (y - F.lit(float(low))) / F.lit(float(high - low) or 1.0)
    m = float(medians(df, [unit])[0])
    label, base = standardised(df, F.abs(unit - F.lit(m))), standardised(df, x)
    mixed = (1 - weight) * base + weight * label
    if cross:
        mixed = mixed + weight * standardised(df, base * label)
    return standardised(df, mixed)
