"""How close two tables are: distributions, correlations, tails, privacy, separability and usefulness for learning."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varileaf.functions import draws
from varileaf.operators.marginals import counted
from varileaf.operators.neighbours import nearest
from varileaf.operators.scaling import medians
from varileaf.sources.store import removed, stored

BUCKETS = 64


def _long(df: DataFrame, columns: list[str], side: int) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*", F.lit(1 - side).cast("long").alias("a"), F.lit(side).cast("long").alias("b")).where("x is not null")


def wasserstein(real: DataFrame, made: DataFrame, columns: list[str]) -> DataFrame:
    """feature and w1: the area between the two distribution functions.

    Values are counted first, then dealt to BUCKETS ranges a feature; cumulative counts run inside a range and start from the ranges'
    sums, so no task holds a whole feature.
    """
    counts = _long(real, columns, 0).unionByName(_long(made, columns, 1)).groupBy("feature", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cuts = counts.groupBy("feature").agg(F.percentile_approx("x", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("cuts"))
    # as many rows as features
    dealt = counts.join(F.broadcast(cuts), "feature").withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    sums = dealt.groupBy("feature", "bucket").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.min("x").alias("low"))
    line = W.partitionBy("feature").orderBy("bucket")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    edges = sums.select("feature", "bucket", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("pa"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("pb"), F.lead("low").over(line).alias("after"), F.sum("sa").over(W.partitionBy("feature")).alias("na"), F.sum("sb").over(W.partitionBy("feature")).alias("nb"))
    inside = W.partitionBy("feature", "bucket").orderBy("x")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.select("feature", "bucket", "x", F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb"), F.lead("x").over(inside).alias("next")).join(F.broadcast(edges), ["feature", "bucket"])
    gap = F.abs((F.col("ca") + F.col("pa")) / F.col("na") - (F.col("cb") + F.col("pb")) / F.col("nb")) * (F.coalesce("next", "after") - F.col("x"))
    return placed.groupBy("feature").agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("w1"))


def marginal_fidelity(real: DataFrame, made: DataFrame, columns: list[str]) -> float:
    """1 less the mean of w1 in deviations of the real feature; may be negative."""
    row = real.agg(*[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    spread = {c: (row[i] if row[i] and row[i] > 1e-10 else 1.0) for i, c in enumerate(columns)}
    found = {r.feature: r.w1 for r in wasserstein(real, made, columns).collect()}
    return 1 - sum(found.get(c, 0.0) / spread[c] for c in columns) / len(columns)


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    pairs = list(combinations(columns, 2))
    if not pairs:
        return {}
    row = df.agg(*[F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")) for a, b in pairs]).first()
    return {p: (v if v is not None and v == v else 0.0) for p, v in zip(pairs, row, strict=True)}


def correlation_fidelity(real: DataFrame, made: DataFrame, columns: list[str]) -> float:
    """1 less the Frobenius norm of the difference over that of the real matrix."""
    a, b = correlations(real, columns), correlations(made, columns)
    top = 2 * sum((a[p] - b[p]) ** 2 for p in a)
    return 1 - (top / (len(columns) + 2 * sum(v * v for v in a.values()))) ** 0.5


def correlation_mae(real: DataFrame, made: DataFrame, columns: list[str]) -> float:
    a, b = correlations(real, columns), correlations(made, columns)
    return sum(abs(a[p] - b[p]) for p in a) / max(1, len(a))


def tail_preservation(real: DataFrame, made: DataFrame, columns: list[str]) -> float:
    """Geometric mean of the ratios of the 5 % to 95 % ranges; a made feature without range counts as e^-10, a real one without is left out."""
    import math

    def ranges(df: DataFrame) -> list[float]:
        row = df.agg(*[F.percentile(F.col(f"`{c}`"), F.lit(0.95)) - F.percentile(F.col(f"`{c}`"), F.lit(0.05)) for c in columns]).first()
        return [float(v or 0.0) for v in row]

    logs = [math.log(m / r) if m > 1e-10 else -10.0 for r, m in zip(ranges(real), ranges(made), strict=True) if r > 1e-10]
    return math.exp(sum(logs) / len(logs)) if logs else 1.0


def _middle(found: DataFrame) -> float | None:
    """Median distance; the distances are read more than once, so they are written first."""
    table = stored(found.select("distance"), "distances")
    try:
        return medians(table, [F.col("distance")])[0]
    finally:
        removed(table)


def privacy_dcr(real: DataFrame, made: DataFrame, columns: list[str], ids: list[str]) -> float:
    """Median distance of made rows to the real ones over the real ones' own; infinite where the latter is nothing."""
    numbered = made.withColumn("_m", F.monotonically_increasing_id()) if not set(ids) <= set(made.columns) else made
    key = ["_m"] if "_m" in numbered.columns else ids
    top, low = (_middle(d) for d in (nearest(numbered, real, columns, key), nearest(real, real, columns, ids, exclude_self=True)))
    return top / low if low and low > 1e-10 else float("inf")


def novelty(real: DataFrame, made: DataFrame, columns: list[str], ids: list[str]) -> dict[str, float]:
    """min, mean and 5 % quantile of the made rows' distances to the real ones."""
    row = nearest(made, real, columns, ids).agg(F.min("distance"), F.avg("distance"), F.percentile("distance", F.lit(0.05))).first()
    return dict(zip(("min", "mean", "p5"), row, strict=True))


def dcr_profile(dcr: Column) -> Column:
    return F.when(dcr < 0.4, "Tight").when(dcr < 0.7, "Moderate").when(dcr < 1.0, "High").otherwise("Maximum")


def _features(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in columns])))


def discriminator_accuracy(real: DataFrame, made: DataFrame, columns: list[str], folds: int = 3, seed: int = 42) -> float:
    """Held-out accuracy of a logistic regression that tells made rows from real ones, both weighing the same; 0.5 is best."""
    from pyspark.ml.classification import LogisticRegression

    a, b = real.count(), made.count()
    both = real.select(*columns, F.lit(0.0).alias("label"), F.lit(1 / max(1, a)).alias("w")).unionByName(made.select(*columns, F.lit(1.0).alias("label"), F.lit(1 / max(1, b)).alias("w")))
    data = _features(both, columns).withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "label", *columns), F.lit(folds))).select("features", "label", "w", "fold").cache()
    right = 0.0
    for k in range(folds):
        model = LogisticRegression(weightCol="w", standardization=True).fit(data.where(F.col("fold") != k))
        right += model.transform(data.where(F.col("fold") == k)).agg(F.sum(F.when(F.col("prediction") == F.col("label"), F.col("w")).otherwise(0.0))).first()[0] or 0.0
    data.unpersist()
    return right / 2


def auc(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """class, positives and auc: the share of pairs of a row of the class and another row that the class's score orders rightly, ties counting half.

    scores: class -> column. auc is null where no row or every row is of the class. Scores are counted and ranked in ranges, so no task holds a column.
    """
    kind = dict(df.dtypes)[label]
    own = [df.select(F.lit(k).cast(kind).alias("class"), F.col(f"`{c}`").cast("double").alias("_x"), (F.col(f"`{label}`") == F.lit(k).cast(kind)).cast("long").alias("_in")) for k, c in scores.items()]
    # counted score by score, so that no row is repeated; ranks read the counts alone, which are written once
    each = [x.where("_x is not null and _in is not null").groupBy("class", "_x").agg(F.sum("_in").alias("_in"), F.sum(1 - F.col("_in")).alias("_out")) for x in own]
    counts = stored(reduce(DataFrame.unionByName, each), "scores")
    rows = counted(counts, ["class"], "_x", ["_in", "_out"])
    right = F.sum(F.col("_in") * (F.col("_below__out") + F.col("_out") / 2))
    pairs = F.max(F.col("_all__in").cast("double") * F.col("_all__out"))
    return rows.groupBy("class").agg(F.max("_all__in").alias("positives"), F.when(pairs > 0, right / pairs).alias("auc"))


def weighted_auc(df: DataFrame, label: str, scores: dict) -> float:
    """Of two classes the greater one's auc, of more the mean over the classes that occur, weighted by their rows; NaN where it isn't defined."""
    found = [r for r in auc(df, label, {max(scores): scores[max(scores)]} if len(scores) == 2 else scores).collect() if r.positives]
    rows = sum(r.positives for r in found)
    return sum(r.auc * r.positives for r in found) / rows if rows and all(r.auc is not None for r in found) else float("nan")


def boosted(train: DataFrame, test: DataFrame, columns: list[str], y: str, classes: list[float], name: str, trees: int = 20, seed: int = 42) -> DataFrame:
    """The test table with {name} (the likeliest class) and {name}_{k} (the probability of class k) by boosted trees: one model of two classes, else one of each class against the rest."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    place = {k: v for k, v in enumerate(classes)}
    out = _features(test, columns)
    data = _features(train, columns).select("features", F.col(f"`{y}`").cast("double").alias("_y")).cache()
    learnt = [1] if len(classes) == 2 else list(place)
    for k in learnt:
        own = data.withColumn("_l", (F.col("_y") == F.lit(place[k])).cast("double"))
        model = GBTClassifier(maxIter=trees, maxDepth=3, seed=seed, labelCol="_l", predictionCol="_p").setRawPredictionCol("_r").setProbabilityCol("_q").fit(own)
        out = model.transform(out).withColumn(f"_{name}_{k}", vector_to_array("_q")[1]).drop("_p", "_r", "_q")
    data.unpersist()
    if len(classes) == 2:
        out = out.withColumn(f"_{name}_0", 1 - F.col(f"_{name}_1"))
    own = [F.col(f"_{name}_{k}") for k in place]
    whole = F.greatest(sum(own[1:], own[0]), F.lit(1e-300))
    best = F.greatest(*own)
    pick = F.coalesce(*[F.when(own[k] == best, F.lit(v)) for k, v in place.items()])
    return out.select("*", *[(own[k] / whole).alias(f"{name}_{k}") for k in place], pick.alias(name)).drop(*[f"_{name}_{k}" for k in place], "features")


def _classes(train: DataFrame, y: str) -> list[float]:
    """Up to 21 distinct labels, in order."""
    return sorted(r.v for r in train.select(F.col(f"`{y}`").cast("double").alias("v")).where("v is not null").distinct().limit(21).collect())


def learned(train: DataFrame, test: DataFrame, columns: list[str], y: str, metric: str = "score", trees: int = 20, seed: int = 42) -> float:
    """Boosted trees trained on one table and judged on another: F1 or (metric "auc") the weighted AUC up to 20 distinct labels, R2 beyond."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor

    classes = _classes(train, y)
    if len(classes) > 20:
        a, b = (_features(x, columns).select("features", F.col(f"`{y}`").cast("double").alias("label")) for x in (train, test))
        return RegressionEvaluator(metricName="r2").evaluate(GBTRegressor(maxIter=trees, maxDepth=3, seed=seed).fit(a).transform(b))
    if len(classes) < 2:
        return 0.0
    judged = boosted(train, test, columns, y, classes, "p", trees, seed).withColumn("_label", F.col(f"`{y}`").cast("double"))
    if metric == "auc":
        return weighted_auc(judged, "_label", {v: f"p_{k}" for k, v in enumerate(classes)})
    return MulticlassClassificationEvaluator(metricName="f1", predictionCol="p", labelCol="_label").evaluate(judged)


def tstr(real: DataFrame, made: DataFrame, test: DataFrame, columns: list[str], y: str, metric: str = "score") -> dict[str, float]:
    """Trained on made and on real rows, judged on a test table, and the difference."""
    a, b = learned(made, test, columns, y, metric), learned(real, test, columns, y, metric)
    return {"tstr": a, "trtr": b, "delta": a - b}


def emergence(real: DataFrame, made: DataFrame, test: DataFrame, columns: list[str], y: str) -> float:
    """Share of test rows that end in the same leaf of two trees of depth 5, one trained on each table."""
    from pyspark.ml.regression import DecisionTreeRegressor

    data = _features(test, columns)
    for k, train in enumerate((real, made)):
        tree = DecisionTreeRegressor(maxDepth=5, leafCol=f"leaf{k}", predictionCol=f"p{k}", labelCol="_y", seed=42)
        data = tree.fit(_features(train, columns).withColumn("_y", F.col(y).cast("double"))).transform(data)
    return data.agg(F.avg((F.col("leaf0") == F.col("leaf1")).cast("double"))).first()[0]


def error_explanation(full: DataFrame, reduced: DataFrame, test: DataFrame, columns: list[str], y: str, trees: int = 20) -> dict[str, float]:
    """Errors of a model of the full table on the test rows; of the reduced table's model the share of them that it gets right and its AUC on them; both models' AUC on all test rows.

    Without errors coverage_rate and error_set_auc are 1; with more than 20 distinct labels, or with fewer than two, all are NaN.
    """
    keys = ("n_errors", "coverage_rate", "error_set_auc", "full_trtr_auc", "full_tstr_auc")
    classes = _classes(full, y)
    if not 2 <= len(classes) <= 20:
        return dict.fromkeys(keys, float("nan"))
    data = boosted(reduced, boosted(full, test, columns, y, classes, "p", trees), columns, y, classes, "q", trees).withColumn("_label", F.col(f"`{y}`").cast("double")).cache()
    first, second = ({v: f"{n}_{k}" for k, v in enumerate(classes)} for n in "pq")
    wrong = data.where("p != _label")
    row = wrong.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("q") == F.col("_label")).cast("double")).alias("right"), F.count_distinct("_label").alias("labels")).first()
    on_errors = 1.0 if not row.n else weighted_auc(wrong, "_label", second) if row.labels > 1 else float("nan")
    out = dict(zip(keys, (row.n, row.right if row.n else 1.0, on_errors, weighted_auc(data, "_label", first), weighted_auc(data, "_label", second)), strict=True))
    data.unpersist()
    return out


def boundary_escape(made: DataFrame, columns: list[str], low: float, high: float) -> float:
    outside = [(F.col(c) < low) | (F.col(c) > high) for c in columns]
    any_ = outside[0]
    for o in outside[1:]:
        any_ = any_ | o
    return made.agg(F.avg(any_.cast("double"))).first()[0]


def arc_gap(df: DataFrame, x: str, y: str, bins: int = 36) -> float:
    """Longest empty run of angular bins around the circle, in degrees."""
    angle = F.floor((F.atan2(F.col(y), F.col(x)) / (2 * 3.141592653589793) + 0.5) * bins)
    taken = sorted({int(r[0]) % bins for r in df.select(angle.alias("b")).where("b is not null").distinct().collect()})
    if not taken:
        return 360.0
    gaps = [(b - a) % bins or bins for a, b in zip(taken, taken[1:] + taken[:1], strict=True)]
    return (max(gaps) - 1) * 360 / bins


def purity(df: DataFrame, label: str, by: str = "partition_id") -> DataFrame:
    """partition, n, dominant label and purity, in one two-level aggregation."""
    counts = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy(by).agg(F.sum("k").alias("n"), F.max_by(label, F.struct("k", F.col(label))).alias("dominant"), (F.max("k") / F.sum("k")).alias("purity"))


def cohesion(df: DataFrame, vector: str, by: str) -> DataFrame:
    """Mean pairwise cosine within each group, from the sum of the unit vectors: no pair is made."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    unit = df.select(by, F.posexplode(F.transform(x, lambda v: v / norm)).alias("i", "u"))
    sums = unit.groupBy(by, "i").agg(F.sum("u").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).select(by, "n", F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cosine"))


def moments(df: DataFrame, columns: list[str], by: str = "partition_id") -> DataFrame:
    """Mean |skewness| and |excess kurtosis| of each group with four rows or more; a feature without spread counts as 0."""
    n = len(columns)
    flat = lambda c, v: F.when(F.stddev_pop(c) < 1e-8, 0.0).otherwise(F.abs(v(c)))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (sum((flat(c, F.skewness) for c in columns), F.lit(0.0)) / n).alias("skewness"), (sum((flat(c, F.kurtosis) for c in columns), F.lit(0.0)) / n).alias("kurtosis")).where("n >= 4")


def composition(df: DataFrame, label: str, by: str = "partition_id") -> DataFrame:
    """partition, label, share and place: each partition's labels, the most frequent first."""
    counts = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("k"))
    whole = W.partitionBy(by)
    return counts.select(by, label, (F.col("k") / F.sum("k").over(whole)).alias("share"), F.row_number().over(whole.orderBy(F.desc("k"), label)).alias("place"))


def weighted_purity(df: DataFrame, label: str, by: str = "partition_id") -> DataFrame:
    """One row: the mean purity of partitions, weighted by their sizes."""
    return purity(df, label, by).agg((F.sum(F.col("purity") * F.col("n")) / F.sum("n")).alias("purity"))


def signal_to_noise(df: DataFrame, y: str, fitted: str) -> DataFrame:
    """One row: the variance of what a model fits over that of what it leaves."""
    return df.agg((F.var_pop(fitted) / F.var_pop(F.col(y) - F.col(fitted))).alias("snr"))


def log_ratio_bias(df: DataFrame, label: str, expected: str, by: str = "partition_id") -> DataFrame:
    """partition, label and bias: the log share of a label in a partition over the log of its mean expected probability there."""
    share = F.col("k") / F.sum("k").over(W.partitionBy(by))
    return df.groupBy(by, label).agg(F.count(F.lit(1)).alias("k"), F.avg(expected).alias("p")).select(by, label, (F.log(share) - F.log("p")).alias("bias"))


def restricted_bias(df: DataFrame, label: str, top: int, by: str = "partition_id") -> DataFrame:
    """partition, label and log_share over the `top` most frequent labels alone, ties by label; a label that a partition lacks has no row."""
    often = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(top)
    counts = df.join(F.broadcast(often.select(label)), label).groupBy(by, label).agg(F.count(F.lit(1)).alias("k"))  # `top` rows
    return counts.select(by, label, F.log(F.col("k") / F.sum("k").over(W.partitionBy(by))).alias("log_share"))


def density(df: DataFrame, low: float, by: str = "partition_id") -> DataFrame:
    """partition, density (its share of all rows) and confidence: LOW below `low`, else OK."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("k"))
    share = F.col("k") / F.sum("k").over(W.partitionBy())  # a row for each partition of a tree
    return counts.select(by, share.alias("density"), F.when(share < low, "LOW").otherwise("OK").alias("confidence"))


def at_risk(df: DataFrame, d: int, by: str = "partition_id") -> DataFrame:
    """One row: the share of partitions with fewer rows than d + 1, and the share with fewer than two, which have no density estimate."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("k"))
    return counts.agg(F.avg((F.col("k") < d + 1).cast("double")).alias("at_risk"), F.avg((F.col("k") < 2).cast("double")).alias("failed"))


#: How good a value of a metric is: the higher the better, the lower, or the nearer to a target.
DIRECTIONS = {"higher": lambda v: v, "lower": lambda v: -v, "one": lambda v: -F.abs(v - 1), "half": lambda v: -F.abs(v - 0.5)}


def ranks(results: DataFrame, value: str, direction: str, by: str, name: str) -> DataFrame:
    """Adds place (1 is best, ties by name) and heat (0 to 1, 1 is best; 1 where all are equal) of each row among those of its condition."""
    scored = results.withColumn("_score", DIRECTIONS[direction](F.col(value)))
    own = W.partitionBy(by)
    low, high = F.min("_score").over(own), F.max("_score").over(own)
    heat = F.when(high > low, (F.col("_score") - low) / (high - low)).otherwise(1.0)
    return scored.withColumn("place", F.row_number().over(own.orderBy(F.desc("_score"), name))).withColumn("heat", heat).drop("_score")


def wins(results: DataFrame, value: str, direction: str, by: str, name: str) -> DataFrame:
    """name and wins: in how many conditions it is best."""
    return ranks(results, value, direction, by, name).groupBy(name).agg(F.sum((F.col("place") == 1).cast("long")).alias("wins"))


def evaluate_reduction(real: DataFrame, reduced: DataFrame, columns: list[str]) -> dict[str, float]:
    return {"marginal_fidelity": marginal_fidelity(real, reduced, columns), "correlation_fidelity": correlation_fidelity(real, reduced, columns), "tail_preservation": tail_preservation(real, reduced, columns)}


def evaluate_expansion(real: DataFrame, made: DataFrame, columns: list[str], ids: list[str]) -> dict[str, float]:
    return evaluate_reduction(real, made, columns) | {"discriminator_accuracy": discriminator_accuracy(real, made, columns), "privacy_dcr": privacy_dcr(real, made, columns, ids)}


def folds(df: DataFrame, ids: list[str], k: int, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to k - 1, by hash of the ids."""
    return df.withColumn("fold", F.least(F.lit(k - 1), F.floor(draws.uniform(seed, *[F.col(c) for c in ids]) * k)).cast("int"))
