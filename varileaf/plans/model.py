"""Fit once, then reduce, expand, augment, assign and describe."""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varileaf.functions import geometry as g
from varileaf.operators import budgets as bud
from varileaf.operators import generate, metrics, select, targets, tree
from varileaf.operators.neighbours import nearest
from varileaf.operators.scaling import Scaler, bind, trimmed


#: Levels of a breadth-first tree whose depth isn't set.
BREADTH_LEVELS = 10


@dataclass(frozen=True)
class ReduceParams:
    n: int | None = None
    ratio: float | None = None
    method: str = "fps"
    variance_weighted: bool = True
    n_partitions: int | None = None


@dataclass(frozen=True)
class ExpandParams:
    n: int = 1000
    variance_weighted: bool = False
    bandwidth: float | str | None = None
    adaptive_bandwidth: bool = False
    generation_strategy: str | None = None
    n_partitions: int | None = None


@dataclass(frozen=True)
class AugmentParams:
    n: int = 1000
    variance_weighted: bool = False
    n_partitions: int | None = None


@dataclass(frozen=True)
class Partitioner:
    """Settings of a model. target: a name of targets.KINDS; scaling: std or mad; min_gain: a number, or 'auto' for the information floor;
    growth and colsample: the order and the share of columns of tree.grow. Breadth-first trees have at most 10 levels unless max_depth is set.
    """

    target: str = "pairwise"
    scaling: str = "std"
    criterion: str = "squared_error"
    n_partitions: int | None = None
    min_samples_leaf: int | None = None
    max_depth: int | None = None
    min_samples_per_partition: int = 5
    y_weight: float = 0.0
    y_weight_mode: str = "fixed"
    auto_tune: bool = True
    bandwidth: float | str = "auto"
    random_state: int = 42
    tree_splitter: str = "best"
    growth: str = "best"
    colsample: float = 1.0
    min_gain: float | str = "auto"
    exact: bool = True
    reduce_params: ReduceParams | None = None
    expand_params: ExpandParams | None = None
    augment_params: AugmentParams | None = None

    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__}

    def set_params(self, **changes) -> Partitioner:
        unknown = set(changes) - set(self.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return replace(self, **changes)

    def fit(self, df: DataFrame, features: list[str], ids: list[str], y: str | None = None, categorical: list[str] | None = None, target_col: str | None = None) -> FittedModel:
        """ids must tell rows apart; target_col replaces the geometric target by a column of df.

        With categorical features and y, the categories' projection onto y is a further column of the fit.
        """
        bind(df, [*features, *ids])
        scaler = Scaler(features, self.scaling, list(categorical or []), self.exact).fit(df)
        if y:
            scaler.project(df, y)
        return FittedModel(self, df, scaler, ids, y, target_col)._grown(None)

    def fit_transform(self, df: DataFrame, features: list[str], ids: list[str], y: str | None = None, **changes) -> DataFrame:
        """Fits, then does the one operation whose parameters are set (reduce before expand before augment)."""
        own = self.set_params(**changes)
        model = own.fit(df, features, ids, y)
        for params, run in ((own.reduce_params, model.reduce), (own.expand_params, model.expand), (own.augment_params, model.augment)):
            if params is not None:
                return run(**asdict(params))
        raise ValueError("set reduce_params, expand_params or augment_params")


#: Ready-made settings: the target, its scaling and the tree's criterion.
PRESETS = {
    "pairwise": Partitioner(),
    "sum": Partitioner(target="sum"),
    "robust_pairwise": Partitioner(target="pairwise", scaling="mad", criterion="absolute_error"),
    "robust_sum": Partitioner(target="sum", scaling="mad", criterion="absolute_error"),
    "robust_l1": Partitioner(target="l1", scaling="mad", criterion="absolute_error"),
}


@dataclass
class FittedModel:
    settings: Partitioner
    data: DataFrame
    scaler: Scaler
    ids: list[str]
    y: str | None = None
    target_col: str | None = None
    tree: tree.Tree | None = None
    _derived: dict = field(default_factory=dict)

    @property
    def z(self) -> list[str]:
        return self.scaler.z_columns

    @property
    def n_partitions(self) -> int:
        return len(self.tree.leaves)

    def _grown(self, n_partitions: int | None, min_gain: float | str | None = None) -> FittedModel:
        s = self.settings
        keep = [*self.ids, *([self.y] if self.y else []), *([self.target_col] if self.target_col else [])]
        frame = self.scaler.transform(self.data, list(dict.fromkeys(keep)))
        if self.target_col:
            x = F.col(f"`{self.target_col}`").cast("double")
        else:
            x = targets.geometric(frame, self.z, s.target)
            if self.y and s.y_weight:
                x = targets.blend(frame, x, F.col(f"`{self.y}`").cast("double"), s.y_weight, s.y_weight_mode, s.scaling, s.exact)
        n = frame.count()
        only_reduce = s.reduce_params is not None and s.expand_params is None and s.augment_params is None
        leaves, least = tree.resolved(n, len(self.z), n_partitions or s.n_partitions, s.min_samples_leaf, s.auto_tune, only_reduce)
        floor = s.min_gain if min_gain is None else min_gain
        if floor == "auto":
            floor = tree.min_gain_floor(len(self.z), leaves)
        depth = BREADTH_LEVELS if s.growth == "breadth" and s.max_depth is None else s.max_depth
        grown = tree.grow(frame.withColumn("_target", x), self.z, "_target", leaves, least, depth, float(floor), s.criterion, s.tree_splitter, s.random_state, order=s.growth, colsample=s.colsample)
        if len(grown.leaves) == 1:
            warnings.warn("the tree has one partition: min_gain is above every split's gain; set min_gain=0.0 to partition", stacklevel=3)
        return replace(self, tree=grown, _derived={})

    def derived(self, n_partitions: int | None) -> FittedModel:
        """The model of another number of partitions, for one call; this one keeps its tree."""
        if n_partitions is None or n_partitions == self.settings.n_partitions:
            return self
        if n_partitions not in self._derived:
            self._derived[n_partitions] = self._grown(n_partitions)
        return self._derived[n_partitions]

    def refit(self, df: DataFrame, y: str | None = None) -> FittedModel:
        """A new tree on the same scaling, for other labels or targets."""
        return replace(self, data=df, y=y or self.y)._grown(None)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds partition_id; a projection, so streams work too."""
        bind(df, self.scaler.features)
        return self.scaler.transform(df).withColumn("partition_id", self.tree.leaf()).drop(*self.z)

    def assigned(self, df: DataFrame | None = None) -> DataFrame:
        """ids, z columns and partition_id, of the fitted table by default."""
        return self.scaler.transform(self.data if df is None else trimmed(df, self.scaler.features, self.ids), self.ids).withColumn("partition_id", self.tree.leaf())

    def _profile(self, frame: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
        mean_abs = g.total([F.abs(F.col(c)) for c in self.z]) / len(self.z)
        rows = sorted(frame.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"), F.avg(mean_abs).alias("m")).collect())
        return [r.partition_id for r in rows], np.array([r.n for r in rows], np.int64), np.array([r.m for r in rows], float)

    def reduce(self, n: int | None = None, ratio: float | None = None, method="fps", variance_weighted: bool = True, n_partitions: int | None = None, X: DataFrame | None = None, return_indices: bool = False) -> DataFrame:
        """Rows of the fitted table (or of X) with partition_id and selection_rank; return_indices: their ids alone."""
        model = self.derived(n_partitions)
        frame = model.assigned(X)
        pids, sizes, mean_abs = model._profile(frame)
        wanted = bud.from_ratio(int(sizes.sum()), n, ratio)
        share = bud.weights(sizes, mean_abs if variance_weighted else None)
        budget = bud.for_reduction(share, sizes, min(wanted, int(sizes.sum())), self.settings.min_samples_per_partition)
        chosen = select.select(frame, self.ids, self.z, dict(zip(pids, budget.tolist(), strict=True)), method, self.settings.random_state)
        if return_indices:
            return chosen.select(*self.ids)
        return (self.data if X is None else X).join(chosen, self.ids)

    def expand(self, n: int, variance_weighted: bool = False, bandwidth: float | str | None = None, adaptive_bandwidth: bool = False, generation_strategy=None, n_partitions: int | None = None, X: DataFrame | None = None, novelty: float = 0.0, return_novelty_stats: bool = False, fallback: bool = False) -> DataFrame | tuple[DataFrame, dict[str, float]]:
        """n synthetic rows: the features in their own units, partition_id and synthetic_id.

        fallback: a strategy's errors in a partition give noisy given rows, told by a column `failed`.
        return_novelty_stats: also min, mean and p5 of their distances to the nearest given row, over the z columns of the numeric features.
        """
        if n <= 0:
            raise ValueError("n must be positive")
        model = self.derived(n_partitions)
        frame = model.assigned(X)
        rule = self.settings.bandwidth if bandwidth is None else bandwidth
        strategy = generation_strategy or ("epanechnikov" if rule in ("auto", "epanechnikov") else "multivariate_kde")
        if adaptive_bandwidth:
            if rule == "auto":
                warnings.warn("adaptive_bandwidth has no effect on the automatic bandwidth", stacklevel=2)
            else:
                rule = "adaptive"
        pids, sizes, mean_abs = model._profile(frame)
        budget = bud.allocate(bud.weights(sizes, mean_abs if variance_weighted else None), n)
        planned = dict(zip(pids, budget.tolist(), strict=True))
        numeric = [f"z_{c}" for c in self.scaler.features if c not in self.scaler.categorical]
        codes = [f"z_{c}" for c in self.scaler.categorical]
        seed = self.settings.random_state
        made = generate.generate(frame, self.ids, numeric, planned, strategy, rule, seed, novelty, fallback) if numeric else generate.slots(frame, planned).select(F.col("_pid").alias("partition_id"), F.col("_i").alias("synthetic_id"))
        if codes:
            made = generate.categories(frame, codes, made, seed)
        out = self.scaler.inverse(made)
        if not return_novelty_stats:
            return out
        if not numeric:
            raise ValueError("novelty statistics need numeric features")
        return out, metrics.novelty(frame, made, numeric, ["partition_id", "synthetic_id"])

    def augment(self, n: int, variance_weighted: bool = False, n_partitions: int | None = None) -> DataFrame:
        """The given rows and synthetic ones, n in all."""
        rows = self.data.count()
        if n <= rows:
            raise ValueError(f"n must exceed the {rows} given rows")
        made = self.expand(n - rows, variance_weighted, n_partitions=n_partitions)
        given = self.transform(self.data).select(*self.scaler.features, "partition_id", F.lit(False).alias("is_synthetic"))
        return given.unionByName(made.select(*self.scaler.features, "partition_id", F.lit(True).alias("is_synthetic")))

    def get_partitions(self) -> DataFrame:
        """partition_id, size, mean_abs_z and variance (over all cells of the partition)."""
        cells = F.count(F.lit(1)) * len(self.z)
        z = [F.col(c) for c in self.z]
        first, second = F.sum(g.signed_sum(z)) / cells, F.sum(g.square_sum(z)) / cells
        return self.assigned().groupBy("partition_id").agg(F.count(F.lit(1)).alias("size"), F.avg(g.total([F.abs(c) for c in z]) / len(z)).alias("mean_abs_z"), (second - first * first).alias("variance"))

    def norm_variances(self) -> DataFrame:
        """partition_id, size and the variance of the rows' norms."""
        return self.assigned().groupBy("partition_id").agg(F.count(F.lit(1)).alias("size"), F.var_pop(F.sqrt(g.square_sum([F.col(c) for c in self.z]))).alias("variance"))

    def geometry_stats(self, X: DataFrame | None = None) -> dict:
        frame = self.assigned(X)
        out = geometry_summary(frame, self.z).first().asDict()
        d = len(self.z)
        out |= {"n_features": d, "cone_critical_angle_deg": math.degrees(math.acos(1 / math.sqrt(max(d, 1))))}
        out["partitions"] = [r.asDict() for r in geometry_by_partition(frame, self.z).orderBy("id").collect()]
        return out

    def compute_novelty(self, df: DataFrame, ids: list[str]) -> DataFrame:
        """ids and distance of each row of df to the nearest fitted row, over all z columns."""
        return nearest(self.scaler.transform(df, ids), self.assigned(), self.z, ids)

    def recommend_params(self, reduction: bool = True) -> dict[str, int]:
        leaves, least = tree.tuned(self.data.count(), len(self.z), reduction)
        return {"n_partitions": leaves, "min_samples_leaf": least}

    def save(self, spark: SparkSession, path: str) -> None:
        """Scaling and tree, as a one-row table."""
        s = self.scaler
        state = {"scaler": s.to_dict(), "tree": self.tree.to_json(), "ids": self.ids, "y": self.y}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, data: DataFrame, settings: Partitioner | None = None) -> FittedModel:
        state = json.loads(spark.read.schema("state string").json(path).first().state)
        return cls(settings or Partitioner(), data, Scaler.from_dict(state["scaler"]), state["ids"], state["y"], None, tree.Tree.from_json(state["tree"]))


def _safe(x, low: float = 1e-12):
    return F.when((F.stddev_pop(x[0]) > low) & (F.stddev_pop(x[1]) > low), F.corr(*x))


def geometry_summary(frame: DataFrame, z: list[str]) -> DataFrame:
    """One row: moments of T and Q, their relation, and the share of rows in the cone."""
    c = [F.col(x) for x in z]
    t, q = F.col("_T"), F.col("_Q")
    inside = F.avg((t > 0).cast("double"))
    return frame.select(g.cooperation(c).alias("_T"), g.square_sum(c).alias("_Q")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(t).alias("E_T"), F.avg(q).alias("E_Q"), F.stddev_pop(t).alias("std_T"), F.stddev_pop(q).alias("std_Q"), F.covar_samp(t, q).alias("cov_TQ"), _safe((t, q)).alias("corr_TQ"),
        inside.alias("frac_in_cone"), (F.avg(t) / (F.avg(q) + 1e-12)).alias("cooperation_ratio"), ((inside < 0.05) | (inside > 0.95) | (F.stddev_pop(t) < 1e-6)).alias("cone_degenerate"),
    )


def geometry_by_partition(frame: DataFrame, z: list[str]) -> DataFrame:
    c = [F.col(x) for x in z]
    t, q, n = F.col("_T"), F.col("_Q"), F.count(F.lit(1))
    inside, spread = F.avg((t > 0).cast("double")), lambda x: F.when(n > 1, F.stddev_pop(x))
    return frame.select("partition_id", g.cooperation(c).alias("_T"), g.square_sum(c).alias("_Q")).groupBy(F.col("partition_id").alias("id")).agg(
        n.alias("n"), F.avg(t).alias("E_T"), F.avg(q).alias("E_Q"), spread(t).alias("std_T"), spread(q).alias("std_Q"), inside.alias("frac_in_cone"), ((n < 2) | (inside < 0.05) | (inside > 0.95) | F.coalesce(spread(t) < 1e-6, F.lit(False))).alias("cone_degenerate"),
    )


def sign_by_partition(frame: DataFrame, z: list[str]) -> DataFrame:
    """Of each partition: size, means and deviations of S, Q, T and A, the mean minority sign, and the share of rows in the cone.

    A deviation is null in a partition of one row.
    """
    c = [F.col(x) for x in z]
    named = {"S": g.signed_sum(c), "Q": g.square_sum(c), "T": g.cooperation(c), "A": g.sign_deficit(c)}
    rows = frame.select("partition_id", *[v.alias(f"_{k}") for k, v in named.items()], g.minority_sign(c).alias("_M"))
    n = F.count(F.lit(1))
    aggs = [n.alias("n")]
    for k in named:
        aggs += [F.avg(f"_{k}").alias(f"{k}_mean"), F.when(n > 1, F.stddev_pop(f"_{k}")).alias(f"{k}_std")]
    return rows.groupBy(F.col("partition_id").alias("id")).agg(*aggs, F.avg("_M").alias("minority_sign_mean"), F.avg((F.col("_T") > 0).cast("double")).alias("cone_fraction"))


def sign_summary(frame: DataFrame, z: list[str]) -> DataFrame:
    """One row about S, Q, T, A and the minority sign: moments, ranges, correlations, and how A and T scale when z doubles."""
    c = [F.col(x) for x in z]
    double = [2 * x for x in c]
    named = {"S": g.signed_sum(c), "Q": g.square_sum(c), "T": g.cooperation(c), "A": g.sign_deficit(c)}
    rows = frame.select(*[v.alias(k) for k, v in named.items()], g.minority_sign(c).alias("M"), g.sign_deficit(double).alias("A2"), g.cooperation(double).alias("T2"))
    aggs = [F.count(F.lit(1)).alias("n"), F.lit(len(z)).alias("d")]
    for k in named:
        aggs += [F.avg(k).alias(f"{k}_mean"), F.stddev_pop(k).alias(f"{k}_std"), F.min(k).alias(f"{k}_min"), F.max(k).alias(f"{k}_max")]
    col = F.col
    return rows.agg(
        *aggs, F.avg((col("T") > 0).cast("double")).alias("cone_fraction"), (F.avg("T") / (F.avg("Q") + 1e-12)).alias("cooperation_ratio"), (-F.avg(F.sqrt("Q")) * math.sqrt(len(z))).alias("A_theoretical_lower_bound"),
        F.avg((col("A") >= -1e-10).cast("double")).alias("sign_consistent_fraction"), F.avg("M").alias("minority_sign_mean"),
        _safe((col("T"), col("Q"))).alias("corr_TQ"), _safe((col("A"), col("Q"))).alias("corr_AQ"), _safe((col("A"), col("T"))).alias("corr_AT"), _safe((col("A"), F.abs(col("S")))).alias("corr_AS"),
        F.avg(F.when(col("A") < -1e-10, col("A2") / col("A"))).alias("A_homogeneity"), F.avg(F.when(F.abs(col("T")) > 1e-10, col("T2") / col("T"))).alias("T_homogeneity"),
    )
