"""Compositions of fits: hierarchies, residual rounds, linear models of partitions, two-phase expansion, parameter search, runs."""

from __future__ import annotations

import random
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varileaf.functions import geometry
from varileaf.operators import baselines, metrics, tree
from varileaf.plans.model import FittedModel, Partitioner
from varileaf.sources.datasets import DATASETS, feature_columns
from varileaf.sources.store import removed, stored
from varileaf.sources.tables import RESULT


#: Groups of one refinement; their statistics and thresholds are collected.
MOST_GROUPS = 10_000


def refined(df: DataFrame, group: str, features: list[str], parts: int, min_leaf: int = 5, max_depth: int | None = None) -> DataFrame:
    """The rows with partition_id: every group (0, 1, ... in the column) split into at most `parts` by a tree of its own, over features that are scaled
    within the group, for their sum. Numbers are dense, group after group.

    A group of fewer than parts * min_leaf rows stays whole. All trees grow together: the number of jobs doesn't depend on the groups. Rows
    without a group or a feature raise an error.
    """
    x = [F.col(f"`{c}`").cast("double") for c in features]
    found = df.groupBy(F.col(f"`{group}`").cast("int").alias("_g")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS or any(r["_g"] is None or r["_g"] < 0 or r["_g"] >= MOST_GROUPS for r in found):
        raise ValueError(f"groups must be numbers from 0 to {MOST_GROUPS - 1}")
    if not found:
        return df.withColumn("partition_id", F.lit(None).cast("int"))
    by = {r["_g"]: r for r in found}
    size = max(by) + 1
    own = F.col(f"`{group}`").cast("int")
    pick = lambda k, other: F.get(F.array(*[F.lit(float((by[g][k] if g in by else None) or other)) for g in range(size)]), own)
    z = [f"_z{i}" for i in range(len(features))]
    scaled = df.select("*", own.alias("_g"), *[((c - pick(f"m{i}", 0.0)) / pick(f"s{i}", 1.0)).alias(z[i]) for i, c in enumerate(x)])
    leaves = [max(1, min(parts, by[g].n // min_leaf)) if g in by and by[g].n >= parts * min_leaf else 1 for g in range(size)]
    forest = tree.grow_forest(scaled.select("_g", *z, geometry.signed_sum([F.col(c) for c in z]).alias("_t")), "_g", z, "_t", leaves, min_leaf, max_depth)
    return scaled.withColumn("partition_id", forest.leaf(F.col("_g"))).drop("_g", *z)


def anchored(df: DataFrame, anchor: list[str], target: list[str], coarse: int, fine: int, min_leaf: int = 5) -> DataFrame:
    """Partitions by one set of features, and within each by another; partition_id numbers the pairs."""
    first = refined(df.withColumn("_all", F.lit(0)), "_all", anchor, coarse, min_leaf).drop("_all")
    return refined(first.withColumnRenamed("partition_id", "_coarse"), "_coarse", target, fine, min_leaf).drop("_coarse")


def many_rounds(df: DataFrame, anchor: list[str], target: list[str], rounds: int, splits: int, min_leaf: int = 5, max_depth: int | None = None) -> DataFrame:
    """Partitions by the anchor features in a first round and by the target features within these in each further one, a few splits at a time."""
    out = df.withColumn("partition_id", F.lit(0))
    for k in range(rounds):
        out = refined(out.withColumnRenamed("partition_id", "_before"), "_before", target if k else anchor, splits, min_leaf, max_depth).drop("_before")
    return out


def hierarchical(df: DataFrame, coarse: FittedModel, fine: Partitioner, features: list[str]) -> DataFrame:
    """Partitions inside each coarse partition; partition_id is the dense number of the pair.

    For the sum of scaled features all trees grow together; other targets take one fit for each coarse leaf.
    """
    given = coarse.transform(df)
    if (fine.target, fine.scaling, fine.criterion, fine.tree_splitter, fine.y_weight) == ("sum", "std", "squared_error", "best", 0.0) and fine.n_partitions:
        return refined(given.withColumnRenamed("partition_id", "_coarse"), "_coarse", features, fine.n_partitions, fine.min_samples_leaf or 5, fine.max_depth).drop("_coarse")
    out, start = None, 0
    for leaf in coarse.tree.leaves:
        part = given.where(F.col("partition_id") == leaf.leaf).drop("partition_id")
        model = fine.fit(part, features, coarse.ids)
        own = model.transform(part).withColumn("partition_id", F.col("partition_id") + F.lit(start))
        out, start = own if out is None else out.unionByName(own), start + model.n_partitions
    return out


def residual_rounds(df: DataFrame, features: list[str], ids: list[str], sizes: tuple[int, ...] = (4, 8, 12), settings: Partitioner | None = None) -> tuple[DataFrame, list[float]]:
    """Partition, subtract the partition's medians, and again; the residual table and the mean squared residual of each round."""
    base = settings or Partitioner(target="l1_norm", scaling="mad", min_gain=0.0)
    current, errors = df.select(*ids, *features), []
    for k in sizes:
        model = base.set_params(n_partitions=k).fit(current, features, ids)
        marked = model.transform(current)
        middle = marked.groupBy("partition_id").agg(*[F.median(c).alias(f"_m{i}") for i, c in enumerate(features)])
        # one row a leaf
        current = marked.join(F.broadcast(middle), "partition_id").select(*ids, *[(F.col(c) - F.col(f"_m{i}")).alias(c) for i, c in enumerate(features)])
        errors.append(current.agg(F.avg(sum((F.col(c) * F.col(c) for c in features), F.lit(0.0)) / len(features))).first()[0])
    return current, errors


def shifted(logits: str, bias: str, alpha: float) -> Column:
    """Logits with alpha times a bias array; without a bias as they are."""
    given = F.transform(F.col(f"`{logits}`"), lambda x: x.cast("double"))
    moved = F.zip_with(given, F.col(f"`{bias}`"), lambda x, b: x + F.lit(float(alpha)) * F.coalesce(b, F.lit(0.0)))
    return F.when(F.col(f"`{bias}`").isNull(), given).otherwise(moved)


def cross_entropy(logits: Column, target: Column) -> Column:
    """Loss of the target's place (from 0) among logits."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))) - F.element_at(logits, target.cast("int") + 1)


def alpha_losses(df: DataFrame, logits: str, target: str, bias: str, alphas: list[float]) -> dict[float, float]:
    """Mean loss for each alpha; the whole grid is one aggregation over one pass of the rows. Rows with a null count in no mean."""
    given = df.select(logits, target, bias).where(F.col(logits).isNotNull() & F.col(target).isNotNull())
    each = given.select(*[cross_entropy(shifted(logits, bias, a), F.col(f"`{target}`")).alias(f"a{k}") for k, a in enumerate(alphas)])
    return dict(zip(alphas, each.agg(*[F.avg(c).alias(c) for c in each.columns]).first(), strict=True))


def corrected(df: DataFrame, valid: DataFrame, features: list[str], ids: list[str], logits: str, target: str, rounds: int = 3, alphas: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0), settings: Partitioner | None = None) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Additive corrections: in each round the table's rows are partitioned anew by the features, a partition's bias is the mean of (1 at the target) less
    the softmax of the present logits, and the alpha of the least loss on the valid rows (the first of equals) says how much of it is added.

    Returns the valid rows with corrected logits, and alpha and loss of each round. Each round's rows are written to the shared folder.
    """
    base = settings or Partitioner(target="sum", n_partitions=8, min_gain=0.0)
    kept = list(dict.fromkeys([*ids, *features, target]))
    train, held = (x.select(*kept, F.transform(F.col(f"`{logits}`"), lambda v: v.cast("double")).alias(logits)) for x in (df, valid))
    story: list[tuple[float, float]] = []
    for k in range(rounds):
        model = base.set_params(random_state=base.random_state + k).fit(train, features, ids)
        top = F.array_max(logits)
        whole = F.aggregate(F.col(logits), F.lit(0.0), lambda a, x: a + F.exp(x - top))
        gaps = model.transform(train).select("partition_id", F.posexplode(F.transform(F.col(logits), lambda x, i: (i == F.col(f"`{target}`").cast("int")).cast("double") - F.exp(x - top) / whole)).alias("_c", "_v"))
        means = gaps.groupBy("partition_id", "_c").agg(F.avg("_v").alias("_v")).groupBy("partition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_v"))), lambda x: x["_v"]).alias("_bias"))
        # a tree's leaves times the classes
        marked = [model.transform(x).join(means, "partition_id", "left") for x in (train, held)]
        losses = alpha_losses(marked[1], logits, target, "_bias", list(alphas))
        alpha = min(alphas, key=lambda a: losses[a])
        story.append((alpha, losses[alpha]))
        before = (train, held) if k else ()
        train, held = (stored(x.select(*kept, shifted(logits, "_bias", alpha).alias(logits)), f"corrected-{k}") for x in marked)
        for x in before:
            removed(x)
    return held, story


def linear_models(df: DataFrame, features: list[str], y: str, by: str = "partition_id") -> DataFrame:
    """by, n and weights (the intercept last): least squares in each partition, from its normal equations alone."""
    x = [*[F.col(c).cast("double") for c in features], F.lit(1.0)]
    d = len(x)
    moments = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(d) for j in range(i + 1)], *[F.sum(x[i] * F.col(y)).alias(f"y{i}") for i in range(d)])

    def solve(frames):
        for frame in frames:
            weights = []
            for r in frame.to_dict("records"):
                a = np.array([[r[f"x{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)])
                weights.append(np.linalg.lstsq(a, np.array([r[f"y{i}"] for i in range(d)]), rcond=None)[0].tolist())
            yield pd.DataFrame({by: frame[by], "n": frame["n"], "weights": weights})

    return moments.mapInPandas(solve, f"`{by}` {df.schema[by].dataType.simpleString()}, n long, weights array<double>")


def predict_linear(df: DataFrame, models: DataFrame, features: list[str], by: str = "partition_id") -> DataFrame:
    """Adds prediction: the linear model of a row's partition."""
    x = F.array(*[F.col(c).cast("double") for c in features], F.lit(1.0))
    value = F.aggregate(F.zip_with(x, "weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.join(models.select(by, "weights"), by).withColumn("prediction", value).drop("weights")


def two_phase(settings: Partitioner, df: DataFrame, features: list[str], ids: list[str], n: int, factor: int = 2) -> DataFrame:
    """Expands with a narrow kernel, fits on the result, and expands that."""
    wide = settings.fit(df, features, ids).expand(factor * df.count(), bandwidth=0.1)
    return settings.fit(wide, features, ["partition_id", "synthetic_id"]).expand(n)


def rare_capture(full: DataFrame, subset: DataFrame, rare: str) -> float:
    """Share of rare rows in the subset over that in the table."""
    a, b = (x.agg(F.avg(F.expr(rare).cast("double"))).first()[0] for x in (subset, full))
    return a / b if b else float("nan")


def fingerprint(df: DataFrame) -> int:
    """The same for equal rows in any order: tells whether two runs agree."""
    return int(df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0] or 0)


def smallest_ratio(model: FittedModel, score: Callable[[DataFrame], float], keep: float = 0.95, ratios: tuple[float, ...] = (0.5, 0.3, 0.2, 0.15, 0.1, 0.05)) -> tuple[float, DataFrame]:
    """The smallest ratio whose reduction keeps that share of the full table's score."""
    full = score(model.data)
    best = (1.0, model.data)
    for r in ratios:
        reduced = model.reduce(ratio=r)
        if score(reduced) >= keep * full:
            best = (r, reduced)
    return best


#: What a search draws from; the first of each is the default.
SPACE = {"n_partitions": (None, 20, 30, 50, 75, 100), "min_samples_leaf": (None, 5, 10, 15), "y_weight": (0.0, 0.1, 0.3, 0.5), "bandwidth": ("auto", 0.1, 0.3, "epanechnikov"), "variance_weighted": (False, True)}


@dataclass
class Search:
    """Seeded search over SPACE; the first trial takes the defaults. objective: parameters -> score, or the held-out TSTR less TRTR."""

    n_trials: int = 30
    cv: int = 3
    expansion_ratio: float = 5.0
    objective: Callable[[dict], float] | None = None
    timeout: float | None = None
    random_state: int = 0
    settings: Partitioner = field(default_factory=lambda: Partitioner(min_gain=0.0))
    trials: list[tuple[dict, float]] = field(default_factory=list)

    def _score(self, df: DataFrame, features: list[str], ids: list[str], y: str | None, params: dict) -> float:
        if self.objective is not None:
            return float(self.objective(params))
        if y is None:
            return 0.0
        marked, own = metrics.folds(df, ids, self.cv, self.random_state), dict(params)
        weighted = own.pop("variance_weighted")
        scores = []
        for k in range(self.cv):
            train, test = marked.where(F.col("fold") != k), marked.where(F.col("fold") == k)
            model = self.settings.set_params(**own).fit(train, [*features, y], ids, y=y)
            made = model.expand(int(self.expansion_ratio * train.count()), variance_weighted=weighted)
            labels = [float(r[0]) for r in train.select(y).distinct().limit(21).collect()]
            if len(labels) <= 20:
                from varileaf.functions.geometry import nearest_label

                made = made.withColumn(y, nearest_label(F.col(y), labels))
            scores.append(metrics.tstr(train, made, test, features, y)["delta"])
        return statistics.fmean(scores)

    def run(self, df: DataFrame, features: list[str], ids: list[str], y: str | None = None) -> FittedModel:
        """Tries, then fits the best on all rows; a trial that fails scores minus infinity and keeps its error."""
        rng, start = random.Random(self.random_state), time.monotonic()
        for t in range(self.n_trials):
            if self.timeout and t and time.monotonic() - start > self.timeout:
                break
            params = {k: v[0] if t == 0 else rng.choice(v) for k, v in SPACE.items()}
            try:
                score = self._score(df, features, ids, y, params)
            except Exception as e:  # a search goes on without a trial that can't be fitted
                params, score = {**params, "error": str(e)}, float("-inf")
            self.trials.append((params, score))
        self.best_params, self.best_score = max(self.trials, key=lambda x: x[1])
        own = {k: v for k, v in self.best_params.items() if k not in ("variance_weighted", "error")}
        return self.settings.set_params(**own).fit(df, features, ids, y)


def mode_params(found: list[dict]) -> dict:
    """The most common value of each parameter."""
    return {k: statistics.mode(x[k] for x in found) for k in found[0]}


def run_reduction(spark: SparkSession, names: list[str], ratios: tuple[float, ...] = (0.1, 0.3), n: int = 5_000) -> DataFrame:
    """Results of reducing generated tables by the model's methods and by the baselines."""
    rows = []
    for name in names:
        df = DATASETS[name](spark, n).cache()
        features = feature_columns(df)
        model = Partitioner(min_gain=0.0).fit(df, features, ["row_id"])
        for ratio in ratios:
            made = {m: model.reduce(ratio=ratio, method=m) for m in ("fps", "stratified", "variance_ordered")}
            made["random"] = baselines.random_rows(df, ["row_id"], max(1, int(n * ratio)))
            rows += [("reduce", name, m, {"ratio": ratio}, metrics.evaluate_reduction(df, x, features), time.strftime("%FT%TZ", time.gmtime())) for m, x in made.items()]
        df.unpersist()
    return spark.createDataFrame(rows, RESULT)


def run_expansion(spark: SparkSession, names: list[str], ratio: float = 1.0, n: int = 2_000, strategies: tuple[str, ...] = ("epanechnikov", "multivariate_kde", "univariate_kde_copula", "bootstrap_noise")) -> DataFrame:
    rows = []
    for name in names:
        df = DATASETS[name](spark, n).cache()
        features = feature_columns(df)
        model = Partitioner(min_gain=0.0).fit(df, features, ["row_id"])
        for s in strategies:
            made = model.expand(int(n * ratio), generation_strategy=s).cache()
            rows.append(("expand", name, s, {"ratio": ratio}, metrics.evaluate_reduction(df, made, features), time.strftime("%FT%TZ", time.gmtime())))
            made.unpersist()
        df.unpersist()
    return spark.createDataFrame(rows, RESULT)
