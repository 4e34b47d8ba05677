"""Synthesising a budget of rows in every partition, as expressions over base rows or as kernels on groups.

Input: a table with ids, z columns and partition_id; budgets: partition_id -> rows. Output: z columns, partition_id and synthetic_id.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varileaf.functions import draws
from varileaf.functions import geometry as g
from varileaf.operators import marginals
from varileaf.operators.budgets import largest_remainder
from varileaf.operators.scaling import MAD_FACTOR
from varileaf.operators.select import GROUP_ROWS, ranked

#: Slots that one row of the slot table unfolds to.
CHUNK = 100_000
LEAST_STD = 0.01
#: Tries of the rejecting strategy, and the quantiles of A that it accepts.
TRIES, A_LOW, A_HIGH = 20, 0.05, 0.95


@runtime_checkable
class GenerationStrategy(Protocol):
    """A custom strategy: `budget` rows like those of z."""

    def __call__(self, z: np.ndarray, budget: int, seed: int) -> np.ndarray: ...


def bandwidth_factor(rule: float | str, n: Column, d: int, budget: Column | None = None) -> Column:
    if rule == "adaptive":
        wide = F.pow(F.greatest(F.lit(1.0), budget / n), F.lit(1 / d))
        return F.when(n < 2, F.pow(n, F.lit(-1 / (d + 4)))).otherwise(F.pow(n, F.lit(-1 / (d + 4))) * wide)
    if rule in ("auto", "scott", "epanechnikov"):
        return F.pow(n.cast("double"), F.lit(-1 / (d + 4)))
    if rule == "silverman":
        return F.pow(n * (d + 2) / 4, F.lit(-1 / (d + 4)))
    return F.lit(float(rule))


class Slot:
    """What a strategy's expressions may use for one slot of a partition."""

    def __init__(self, d: int, seed: int):
        self.d, self.seed = d, seed
        self.i, self.n, self.budget, self.pid, self.h = (F.col(f"_{k}") for k in ("i", "n", "budget", "pid", "h"))

    def col(self, kind: str) -> list[Column]:
        """a, b: base rows; s: deviations; c: means; m: MADs."""
        return [F.col(f"_{kind}{j}") for j in range(self.d)]

    def uniform(self, *keys) -> Column:
        return draws.uniform(self.seed, self.pid, self.i, *keys)

    def normal(self, *keys) -> Column:
        return draws.normal(self.seed, self.pid, self.i, *keys)

    def noise(self, *keys) -> Column:
        return draws.epanechnikov(self.seed, self.pid, self.i, *keys)

    def lattice(self, j: int) -> Column:
        return draws.lattice(self.i, self.budget, j)


Ranks = Callable[[Slot], Column]
Values = Callable[[Slot], list[Column]]


def _any_row(s: Slot) -> Column:
    return F.floor(s.uniform(100) * s.n).cast("long")


def _another_row(s: Slot) -> Column:
    return F.floor(s.uniform(101) * s.n).cast("long")


def _in_turn(s: Slot) -> Column:
    return s.i % s.n


def _stride(s: Slot) -> Column:
    far = (_in_turn(s) + F.greatest(F.lit(1), F.floor(s.n * draws.GOLDEN)).cast("long")) % s.n
    return F.when(far == _in_turn(s), (_in_turn(s) + 1) % s.n).otherwise(far)


def _epanechnikov(s: Slot) -> list[Column]:
    return [a + s.h * sd * s.noise(j) for j, (a, sd) in enumerate(zip(s.col("a"), s.col("s"), strict=True))]


def _unscaled(s: Slot) -> list[Column]:
    return [a + s.h * s.noise(j) for j, a in enumerate(s.col("a"))]


def _gaussian(s: Slot) -> list[Column]:
    """Noise with the partition's covariance, through its Cholesky factor (rows one after another in _chol)."""
    normal = [s.normal(j) for j in range(s.d)]
    return [a + s.h * g.total([F.element_at("_chol", j * s.d + k + 1) * normal[k] for k in range(j + 1)]) for j, a in enumerate(s.col("a"))]


def _bootstrap(s: Slot) -> list[Column]:
    return [a + 0.1 * sd * s.normal(j) for j, (a, sd) in enumerate(zip(s.col("a"), s.col("s"), strict=True))]


def _signs_kept(s: Slot) -> list[Column]:
    return [F.signum(a) * F.abs(F.abs(a) + s.h * sd * s.noise(j)) for j, (a, sd) in enumerate(zip(s.col("a"), s.col("s"), strict=True))]


def _within_range(s: Slot) -> list[Column]:
    """The first of TRIES whose A lies in the partition's range, else the base row."""
    a, sd = s.col("a"), s.col("s")
    tried = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda k: F.array(*[a[j] + s.h * sd[j] * draws.epanechnikov(s.seed, s.pid, s.i, k, j) for j in range(s.d)]))

    def fits(x: Column) -> Column:
        value = g.sign_deficit([F.element_at(x, j + 1) for j in range(s.d)])
        return (value >= F.col("_low")) & (value <= F.col("_high"))

    chosen = F.coalesce(F.try_element_at(F.filter(tried, fits), F.lit(1)), F.array(*a))
    return [F.element_at(chosen, j + 1) for j in range(s.d)]


def _minority(s: Slot) -> list[Column]:
    """The minority-sign group scaled to another row's total; a little noise on the majority."""
    a, b, sd = s.col("a"), s.col("b"), s.col("s")
    own, wanted = g.minority_sign(a), g.minority_sign(b)
    factor = F.when(own > 1e-10, wanted / own).otherwise(F.lit(1.0))
    positive = g.signed_sum(a) >= 0
    return [F.when((a[j] < 0) == positive, a[j] * factor).otherwise(a[j] + 0.05 * sd[j] * s.normal(j)) for j in range(s.d)]


def _lattice_epanechnikov(s: Slot) -> list[Column]:
    share = s.lattice(s.d)
    return [a + share * (b - a) + draws.epanechnikov_quantile(s.lattice(j)) * s.h * sd for j, (a, b, sd) in enumerate(zip(s.col("a"), s.col("b"), s.col("s"), strict=True))]


def _mixup(s: Slot) -> list[Column]:
    share = F.greatest(F.lit(0.1), F.least(F.lit(0.9), (s.i + F.lit(0.5)) / s.budget))
    return [a + share * (b - a) for a, b in zip(s.col("a"), s.col("b"), strict=True)]


def _laplace(s: Slot) -> list[Column]:
    return [c + F.greatest(m, F.lit(1e-8)) * draws.laplace_quantile(s.lattice(j)) for j, (c, m) in enumerate(zip(s.col("c"), s.col("m"), strict=True))]


def _lattice_bootstrap(s: Slot) -> list[Column]:
    return [a + draws.probit(s.lattice(j)) * 0.1 * sd for j, (a, sd) in enumerate(zip(s.col("a"), s.col("s"), strict=True))]


def _lattice_gaussian(s: Slot) -> list[Column]:
    normal = [draws.probit(s.lattice(j)) for j in range(s.d)]
    return [a + s.h * g.total([F.element_at("_chol", j * s.d + k + 1) * normal[k] for k in range(j + 1)]) for j, a in enumerate(s.col("a"))]


def _opposite(s: Slot) -> Column:
    return (s.i + F.floor(s.n / 2).cast("long") + 1) % s.n


#: name: base row, second row (or none), values, extra statistics
EXPRESSIONS: dict[str, tuple[Ranks | None, Ranks | None, Values, str]] = {
    "epanechnikov": (_any_row, None, _epanechnikov, ""),
    "epanechnikov_unscaled": (_any_row, None, _unscaled, ""),
    "multivariate_kde": (_any_row, None, _gaussian, "chol"),
    "bootstrap_noise": (_any_row, None, _bootstrap, ""),
    "sign_preserving_epanechnikov": (_any_row, None, _signs_kept, ""),
    "a_range_rejection": (_any_row, None, _within_range, "range"),
    "minority_sign_resampler": (_any_row, _another_row, _minority, ""),
    "lattice_epanechnikov": (_in_turn, _stride, _lattice_epanechnikov, ""),
    "simplex_mixup": (_in_turn, _opposite, _mixup, ""),
    "laplace": (None, None, _laplace, "mad"),
    "lattice_bootstrap": (_in_turn, None, _lattice_bootstrap, ""),
    "lattice_kde": (_in_turn, None, _lattice_gaussian, "chol"),
}
ALIASES = {"bootstrap": "bootstrap_noise", "copula": "univariate_kde_copula", "kde": "multivariate_kde", "simplex": "simplex_mixup"}


def slots(df: DataFrame, budgets: dict[int, int]) -> DataFrame:
    """_pid, _budget and _i, one row for each slot, unfolded in chunks over many tasks."""
    chunks = [(int(p), int(b), a, min(int(b), a + CHUNK) - 1) for p, b in sorted(budgets.items()) if b > 0 for a in range(0, int(b), CHUNK)]
    table = df.sparkSession.createDataFrame(chunks, "_pid int, _budget long, _first long, _last long")
    return table.repartition(max(1, min(len(chunks), 2000)), "_first", "_pid").select("_pid", "_budget", F.explode(F.sequence("_first", "_last")).alias("_i"))


def statistics(df: DataFrame, z: list[str], kind: str, least_std: float | None = LEAST_STD) -> DataFrame:
    """One row for each partition: size, deviations and what the strategy needs besides."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for j, c in enumerate(z):
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"_c{j}"), (F.greatest(sd, F.lit(least_std)) if least_std else F.sqrt(sd * sd + 1e-8)).alias(f"_s{j}")]
    if kind == "range":
        a = g.sign_deficit([F.col(c) for c in z])
        aggs += [F.percentile_approx(a, A_LOW, 10000).alias("_low"), F.percentile_approx(a, A_HIGH, 10000).alias("_high")]
    if kind == "chol":
        aggs += [F.covar_samp(z[i], z[j]).alias(f"_v{i}_{j}") for i in range(len(z)) for j in range(i + 1)]
    out = df.groupBy("partition_id").agg(*aggs)
    if kind == "mad":
        middle = df.groupBy("partition_id").agg(*[F.expr(f"percentile_disc(0.5) within group (order by `{c}`)").alias(f"_md{j}") for j, c in enumerate(z)])
        far = df.join(middle, "partition_id").groupBy("partition_id").agg(*[(MAD_FACTOR * F.expr(f"percentile_disc(0.5) within group (order by abs(`{c}` - _md{j}))")).alias(f"_m{j}") for j, c in enumerate(z)])
        out = out.join(far, "partition_id")
    if kind != "chol":
        return out.withColumnRenamed("partition_id", "_pid")
    rows, d = [], len(z)
    for r in out.collect():  # a tree's leaves
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                v = r[f"_v{i}_{j}"]
                cov[i, j] = cov[j, i] = v if v is not None and v == v else 0.0
        w, q = np.linalg.eigh(cov)
        factor = np.linalg.cholesky((q * np.maximum(w, 1e-6)) @ q.T)
        rows.append((r.partition_id, r["_n"], *[float(r[f"_s{j}"]) for j in range(d)], factor.ravel().tolist()))
    return df.sparkSession.createDataFrame(rows, "_pid int, _n long, " + ", ".join(f"_s{j} double" for j in range(d)) + ", _chol array<double>")


def by_expression(df: DataFrame, ids: list[str], z: list[str], budgets: dict[int, int], name: str, bandwidth: float | str = "auto", seed: int = 42) -> DataFrame:
    """Slots joined with their partition's statistics and with the base rows they ask for; all on the JVM."""
    first, second, values, extra = EXPRESSIONS[name]
    d, s = len(z), Slot(len(z), seed)
    lattice = name.startswith("lattice")
    # one row for each leaf of a tree
    table = slots(df, budgets).join(F.broadcast(statistics(df, z, extra, None if lattice else LEAST_STD)), "_pid")
    table = table.withColumn("_h", bandwidth_factor(bandwidth, F.col("_n"), d, F.col("_budget")))
    if first is not None:
        rows = ranked(df.select(*ids, *z, "partition_id"), ids, seed).select(F.col("partition_id").alias("_pid"), F.col("rank").alias("_r"), *z)
        for letter, rank in (("a", first), ("b", second)):
            if rank is not None:
                base = rows.select("_pid", "_r", *[F.col(f"`{c}`").alias(f"_{letter}{j}") for j, c in enumerate(z)])
                table = table.withColumn("_r", rank(s)).join(base, ["_pid", "_r"]).drop("_r")
    return table.select(F.col("_pid").alias("partition_id"), F.col("_i").alias("synthetic_id"), *[v.alias(c) for v, c in zip(values(s), z, strict=True)])


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0, kind="stable")


def _quantile(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.vectorize(NormalDist().inv_cdf)(np.clip(p, 1e-9, 1 - 1e-9))


def copula(z: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """Normal scores' correlation, and each feature's empirical quantiles."""
    from math import erf

    rng, (n, d) = np.random.default_rng(seed), z.shape
    corr = np.corrcoef(_quantile((_ranks(z) + 0.5) / n), rowvar=False).reshape(d, d) if n > 2 else np.eye(d)
    w, q = np.linalg.eigh(np.nan_to_num(corr, nan=0.0) * (1 - np.eye(d)) + np.eye(d))
    normal = rng.standard_normal((budget, d)) @ np.linalg.cholesky((q * np.maximum(w, 1e-6)) @ q.T).T
    p = np.vectorize(lambda v: 0.5 * (1 + erf(v / 2**0.5)))(normal) if budget else normal
    return np.column_stack([np.quantile(z[:, j], p[:, j]) for j in range(d)])


def independent(z: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """Each feature from a row of its own, with Gaussian noise."""
    rng, (n, d) = np.random.default_rng(seed), z.shape
    return np.take_along_axis(z, rng.integers(0, n, (budget, d)), 0) + rng.standard_normal((budget, d)) * z.std(0) * n ** (-1 / 5)


def interpolated(z: np.ndarray, budget: int, seed: int, k: int = 5) -> np.ndarray:
    """Between a row and one of its k nearest."""
    from varileaf.operators.neighbours import squared_distances

    rng, n = np.random.default_rng(seed), len(z)
    base = rng.integers(0, n, budget)
    if n < 2:
        return z[base]
    k = min(k, n - 1)
    out = np.empty((budget, z.shape[1]))
    for a in range(0, budget, 1024):
        own = base[a : a + 1024]
        dist = squared_distances(z[own], z)
        dist[np.arange(len(own)), own] = np.inf
        near = np.argpartition(dist, k - 1, axis=1)[:, :k]
        other = near[np.arange(len(own)), rng.integers(0, k, len(own))]
        out[a : a + 1024] = z[own] + rng.random((len(own), 1)) * (z[other] - z[own])
    return out


def mixture(z: np.ndarray, budget: int, seed: int, rounds: int = 30) -> np.ndarray:
    """Gaussian mixture of up to three components, fitted by expectation maximisation."""
    rng, (n, d) = np.random.default_rng(seed), z.shape
    k = max(1, min(3, n // 10))
    mean, cov, share = z[rng.choice(n, k, replace=False)], np.stack([np.cov(z, rowvar=False).reshape(d, d) + 1e-6 * np.eye(d) if n > 1 else np.eye(d)] * k), np.full(k, 1 / k)
    for _ in range(rounds if k > 1 else 1):
        log = np.stack([np.log(share[c]) - 0.5 * (np.linalg.slogdet(cov[c])[1] + np.einsum("ij,jk,ik->i", z - mean[c], np.linalg.inv(cov[c]), z - mean[c])) for c in range(k)], 1)
        r = np.exp(log - log.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        weight = r.sum(0) + 1e-10
        share, mean = weight / weight.sum(), (r.T @ z) / weight[:, None]
        cov = np.stack([((z - mean[c]) * r[:, c : c + 1]).T @ (z - mean[c]) / weight[c] + 1e-6 * np.eye(d) for c in range(k)])
    label = rng.choice(k, budget, p=share)
    return mean[label] + np.einsum("ijk,ik->ij", np.linalg.cholesky(cov)[label], rng.standard_normal((budget, d)))


def pushed(z: np.ndarray, made: np.ndarray, least: float = 0.3) -> np.ndarray:
    """Moves rows that lie closer to a given one than `least` of the mean nearest distance out to that distance."""
    from varileaf.operators.neighbours import squared_distances

    if len(z) < 2:
        return made
    step, nearest = max(1, (1 << 22) // len(z)), np.empty(len(z))
    for a in range(0, len(z), step):
        own = squared_distances(z[a : a + step], z)
        own[np.arange(len(own)), np.arange(a, a + len(own))] = np.inf
        nearest[a : a + step] = np.sqrt(own.min(1))
    limit = least * float(nearest.mean())
    dist = squared_distances(made, z)
    at = dist.argmin(1)
    near = np.sqrt(dist[np.arange(len(made)), at])
    step = made - z[at]
    flat = near < 1e-12
    turn = np.modf((np.arange(len(made))[:, None] + 0.5) / max(1, len(made)) + np.arange(z.shape[1]) * draws.GOLDEN)[0] * 2 - 1
    step[flat] = turn[flat]
    size = np.linalg.norm(step, axis=1, keepdims=True)
    move = near < limit
    out = made.copy()
    out[move] = z[at[move]] + step[move] / np.maximum(size[move], 1e-12) * limit
    return out


KERNELS: dict[str, GenerationStrategy] = {"univariate_kde_copula": copula, "independent_kde": independent, "knn_interpolation": interpolated, "partition_gmm": mixture}


#: Noise of the rows that stand in for a kernel's, in deviations.
STAND_IN_NOISE = 0.05


def guarded(kernel: GenerationStrategy, z: np.ndarray, budget: int, seed: int) -> tuple[np.ndarray, bool]:
    """A kernel's rows, or, where it raises an error or gives other than `budget` finite rows, given rows with a little noise; and whether it failed.

    A partition of one row isn't given to the kernel: it gets the noisy rows without counting as a failure.
    """
    made = None
    if len(z) > 1:
        try:
            made = np.asarray(kernel(z, budget, seed), float).reshape(budget, z.shape[1])
        except Exception:  # noqa: BLE001  whatever a custom kernel raises
            made = None
        if made is not None and np.isfinite(made).all():
            return made, False
    rng = np.random.default_rng(seed)
    return z[rng.integers(0, len(z), budget)] + STAND_IN_NOISE * rng.standard_normal((budget, z.shape[1])), len(z) > 1


BY_FEATURE = ("univariate_kde_copula", "lattice_copula", "independent_kde")


def by_kernel(df: DataFrame, ids: list[str], z: list[str], budgets: dict[int, int], kernel: GenerationStrategy, seed: int = 42, novelty: float = 0.0, fallback: bool = False) -> DataFrame:
    """Runs a kernel on every partition, or on equal parts of those above GROUP_ROWS, which share the budget.

    fallback: a kernel's errors don't end the job, and a column `failed` tells the rows that stand in (see guarded).
    """
    known = [p for p, b in budgets.items() if b > 0]
    counted = df.where(F.col("partition_id").isin(known)).groupBy("partition_id").count().collect()
    rows = []
    for r in counted:
        parts = -(-r["count"] // GROUP_ROWS)
        done = 0
        for k, b in enumerate(largest_remainder(np.ones(parts), budgets[r.partition_id]).tolist()):
            rows.append((r.partition_id, k, parts, b, done))
            done += b
    table = df.sparkSession.createDataFrame(rows, "partition_id int, _part int, _parts int, _budget long, _start long")
    parts = table.where("_part = 0").select("partition_id", "_parts")
    dealt = df.select(*ids, *z, "partition_id").join(F.broadcast(parts), "partition_id").withColumn("_part", F.pmod(F.xxhash64(*ids), F.col("_parts")).cast("int")).drop("_parts")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ids, kind="stable")
        pid, budget, start, part = (int(frame[c].iloc[0]) for c in ("partition_id", "_budget", "_start", "_part"))
        x = frame[z].to_numpy(float)
        own, failed = hash((seed, pid, part)) & 0x7FFFFFFF, False
        if fallback:
            made, failed = guarded(kernel, x, budget, own)
        else:
            made = np.asarray(kernel(x, budget, own), float).reshape(budget, len(z))
        if novelty and budget:
            made = pushed(x, made, novelty)
        out = pd.DataFrame(made, columns=z)
        out.insert(0, "synthetic_id", np.arange(budget) + start)
        out.insert(0, "partition_id", np.int32(pid))
        if fallback:
            out["failed"] = failed
        return out

    shape = "partition_id int, synthetic_id long, " + ", ".join(f"`{c}` double" for c in z) + (", failed boolean" if fallback else "")
    return dealt.join(table.drop("_parts"), ["partition_id", "_part"]).groupBy("partition_id", "_part").applyInPandas(run, shape)


def by_feature(df: DataFrame, ids: list[str], z: list[str], budgets: dict[int, int], name: str, seed: int = 42) -> DataFrame:
    """Strategies of operators/marginals.py, whatever the size of a partition."""
    s, made = Slot(len(z), seed), slots(df, budgets)
    if name == "independent_kde":
        return marginals.independent(df, ids, z, made, [s.uniform(200 + j) for j in range(s.d)], [s.normal(j) for j in range(s.d)], seed)
    return marginals.copula(df, ids, z, made, [draws.probit(s.lattice(j)) if name == "lattice_copula" else s.normal(j) for j in range(s.d)])


def _not_failed(made: DataFrame, fallback: bool) -> DataFrame:
    return made.withColumn("failed", F.lit(False)) if fallback else made


def generate(df: DataFrame, ids: list[str], z: list[str], budgets: dict[int, int], strategy: str | GenerationStrategy = "epanechnikov", bandwidth: float | str = "auto", seed: int = 42, novelty: float = 0.0, fallback: bool = False) -> DataFrame:
    """fallback: adds `failed`, true for the rows of partitions whose kernel failed; strategies that are expressions don't fail."""
    if isinstance(strategy, str):
        name = ALIASES.get(strategy, strategy)
        if name in EXPRESSIONS:
            if novelty:
                raise ValueError("novelty needs a strategy that works on whole partitions: a callable or one of " + str(sorted(KERNELS)))
            return _not_failed(by_expression(df, ids, z, budgets, name, bandwidth, seed), fallback)
        if name in BY_FEATURE and not (novelty and name in KERNELS):
            if novelty:
                raise ValueError("novelty needs a strategy that works on whole partitions: a callable or one of " + str(sorted(KERNELS)))
            return _not_failed(by_feature(df, ids, z, budgets, name, seed), fallback)
        if name not in KERNELS:
            raise ValueError(f"unknown generation strategy {strategy!r}, expected one of {sorted({*EXPRESSIONS, *BY_FEATURE, *KERNELS})}")
        strategy = KERNELS[name]
    if not isinstance(strategy, Callable):
        raise TypeError("a generation strategy is a callable (z, budget, seed) -> rows")
    return by_kernel(df, ids, z, budgets, strategy, seed, novelty, fallback)


def _above(mark: Column) -> Callable[[Column], Column]:
    return lambda step: step["_to"] > mark


def categories(df: DataFrame, columns: list[str], made: DataFrame, seed: int = 42, by_lattice: bool = False) -> DataFrame:
    """Adds columns drawn independently from each partition's frequencies: by hashed uniforms, or by lattice quantiles of synthetic_id."""
    from pyspark.sql import Window as W

    out = made
    for j, c in enumerate(columns):
        counts = df.groupBy("partition_id", F.col(f"`{c}`").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
        upto = W.partitionBy("partition_id").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = counts.withColumn("_to", F.sum("_k").over(upto)).withColumn("_all", F.sum("_k").over(W.partitionBy("partition_id")))
        table = placed.groupBy("partition_id").agg(F.max("_all").alias("_all"), F.sort_array(F.collect_list(F.struct("_to", "_v"))).alias("_steps"))
        size = made.groupBy("partition_id").agg(F.count(F.lit(1)).alias("_made")) if by_lattice else None
        joined = out.join(F.broadcast(table), "partition_id")  # leaves times categories, both bounded
        joined = joined.join(F.broadcast(size), "partition_id") if by_lattice else joined
        u = draws.lattice(F.col("synthetic_id"), F.col("_made"), j) if by_lattice else draws.uniform(seed + 1, F.col("partition_id"), F.col("synthetic_id"), j)
        mark = u * F.col("_all")
        at = F.element_at(F.filter("_steps", _above(mark)), 1)["_v"]
        out = joined.withColumn(c, at).drop("_steps", "_all", "_made")
    return out
