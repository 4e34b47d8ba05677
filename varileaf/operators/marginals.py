"""Strategies that take each feature by itself: through its empirical quantiles (copulas), or from a row of its own.

A cell is a row here: values are counted, ranked and met by (partition, feature, ...), so no task holds a partition or a feature. Tables of
a row for each leaf and feature carry no broadcast hint: adaptive execution sends them to every task if they are small, and else splits
the keys that have many rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varileaf.functions import draws
from varileaf.functions import geometry as g
from varileaf.operators.select import ranked

#: Points of a feature's distribution function, and ranges that a feature's values are dealt to for ranking.
GRID, RANGES = 2000, 64
#: Correlation matrices keep eigenvalues of this much.
LEAST_EIGENVALUE = 1e-6


def cells(df: DataFrame, z: list[str], keep: list[str]) -> DataFrame:
    """The kept columns, _j (number of the feature) and _x; a row for each cell that isn't null."""
    return df.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in z])).alias("_j", "_x")).where("_x is not null")


def counted(df: DataFrame, by: list[str], x: str, sums: list[str]) -> DataFrame:
    """Distinct values of x within `by`, with sums of columns: of the value, of all smaller ones (_below_...) and of all (_all_...), and the next value (_next).

    Values are dealt to RANGES ranges of about as many values; sums run within a range and start from the ranges' sums.
    """
    counts = df.groupBy(*by, x).agg(*[F.sum(c).alias(c) for c in sums])
    cuts = counts.groupBy(*by).agg(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"))
    dealt = counts.join(cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts")
    whole, line = W.partitionBy(*by), W.partitionBy(*by).orderBy("_range")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in sums], F.min(x).alias("_low"))
    starts = ranges.select(*by, "_range", F.lead("_low").over(line).alias("_after"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_from_{c}") for c in sums], *[F.sum(c).over(whole).alias(f"_all_{c}") for c in sums])
    inside = W.partitionBy(*by, "_range").orderBy(x)
    upto = inside.rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.select(*by, "_range", x, *sums, F.lead(x).over(inside).alias("_then"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_in_{c}") for c in sums])
    return placed.join(starts, [*by, "_range"]).select(*by, x, *sums, F.coalesce("_then", "_after").alias("_next"), *[(F.col(f"_from_{c}") + F.col(f"_in_{c}")).alias(f"_below_{c}") for c in sums], *[f"_all_{c}" for c in sums])


def ranks(df: DataFrame, z: list[str]) -> DataFrame:
    """partition_id, _j, _x, _k (rows with the value), _below__k (rows with smaller ones), _all__k and _next."""
    return counted(cells(df, z, ["partition_id"]).withColumn("_k", F.lit(1).cast("long")), ["partition_id", "_j"], "_x", ["_k"])


def grid(placed: DataFrame) -> DataFrame:
    """partition_id, _j, _g, _low and _high: quantiles at point _g of GRID and at the next one, between the two values around a quantile's place."""
    steps, gaps = F.lit(GRID - 1).cast("long"), F.col("_all__k") - 1
    first, end = F.col("_below__k"), F.col("_below__k") + F.col("_k")
    # points whose place lies on this value or before the next one
    low = F.when(gaps > 0, F.expr(f"(_below__k * {GRID - 1} + _all__k - 2) div (_all__k - 1)")).otherwise(F.lit(0))
    high = F.when(gaps > 0, F.least(steps, F.expr(f"((_below__k + _k) * {GRID - 1} - 1) div (_all__k - 1)"))).otherwise(steps)
    points = placed.select("partition_id", "_j", "_x", F.coalesce("_next", "_x").alias("_next"), first.alias("_first"), (end - 1).alias("_last"), gaps.alias("_gaps"), low.alias("_from"), high.alias("_to")).where("_from <= _to")
    points = points.withColumn("_g", F.explode(F.sequence("_from", "_to"))).withColumn("_at", F.col("_g") * F.col("_gaps"))
    after = F.when(F.expr(f"_at div {GRID - 1}") < F.col("_last"), F.col("_x")).otherwise(F.col("_next"))
    value = F.col("_x") + (F.col("_at") % steps) / steps * (after - F.col("_x"))
    line = W.partitionBy("partition_id", "_j").orderBy("_g")  # GRID rows
    return points.select("partition_id", "_j", "_g", value.alias("_low")).withColumn("_high", F.lead("_low").over(line)).where(F.col("_g") < GRID - 1)


def factors(df: DataFrame, ids: list[str], z: list[str], placed: DataFrame) -> DataFrame:
    """_pid and _chol, the Cholesky factor of the normal scores' correlations; equal values share their mean rank. Fewer than three rows: no correlation."""
    score = placed.select("partition_id", "_j", "_x", draws.probit((F.col("_below__k") + (F.col("_k") + 1) / 2) / (F.col("_all__k") + 1)).alias("_s"))
    d = len(z)
    wide = cells(df, z, [*ids, "partition_id"]).join(score, ["partition_id", "_j", "_x"]).groupBy("partition_id", *ids).agg(*[F.max(F.when(F.col("_j") == j, F.col("_s"))).alias(f"_s{j}") for j in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i)]
    found = wide.groupBy("partition_id").agg(F.count(F.lit(1)).alias("_n"), *[(F.covar_samp(f"_s{i}", f"_s{j}") / (F.stddev_samp(f"_s{i}") * F.stddev_samp(f"_s{j}") + 1e-8)).alias(f"_r{i}_{j}") for i, j in pairs])
    rows = []
    for r in found.collect():  # a tree's leaves
        corr = np.eye(d)
        for i, j in pairs:
            v = r[f"_r{i}_{j}"]
            corr[i, j] = corr[j, i] = v if r["_n"] > 2 and v is not None and v == v else 0.0
        w, q = np.linalg.eigh(corr)
        rows.append((r.partition_id, np.linalg.cholesky((q * np.maximum(w, LEAST_EIGENVALUE)) @ q.T).ravel().tolist()))
    return df.sparkSession.createDataFrame(rows, "_pid int, _chol array<double>")


def _gathered(met: DataFrame, value: Column, z: list[str]) -> DataFrame:
    """Cells back to rows."""
    return met.select("_pid", "_i", "_j", value.alias("_v")).groupBy("_pid", "_i").agg(*[F.max(F.when(F.col("_j") == j, F.col("_v"))).alias(c) for j, c in enumerate(z)]).withColumnsRenamed({"_pid": "partition_id", "_i": "synthetic_id"})


def copula(df: DataFrame, ids: list[str], z: list[str], slots: DataFrame, normal: list[Column]) -> DataFrame:
    """Correlated normal numbers, as shares of their distribution, through each feature's grid of quantiles; the last point is the greatest value."""
    d = len(z)
    placed = ranks(df, z)
    table = slots.join(factors(df, ids, z, placed), "_pid")
    mixed = [g.total([F.element_at("_chol", j * d + k + 1) * normal[k] for k in range(j + 1)]) for j in range(d)]
    share = [F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), draws.normal_share(F.col(f"_m{j}")))) for j in range(d)]
    table = table.select("_pid", "_i", *[m.alias(f"_m{j}") for j, m in enumerate(mixed)]).select("_pid", "_i", F.posexplode(F.array(*share)).alias("_j", "_u"))
    table = table.withColumn("_u", F.col("_u") * (GRID - 1)).withColumn("_g", F.floor("_u").cast("long"))
    met = table.join(grid(placed).withColumnRenamed("partition_id", "_pid"), ["_pid", "_j", "_g"])
    return _gathered(met, F.col("_low") + (F.col("_u") - F.col("_g")) * (F.col("_high") - F.col("_low")), z)


def independent(df: DataFrame, ids: list[str], z: list[str], slots: DataFrame, uniform: list[Column], normal: list[Column], seed: int) -> DataFrame:
    """Each feature from a row of its own, with Gaussian noise of its deviation times n^(-1/5)."""
    stats = df.groupBy(F.col("partition_id").alias("_pid")).agg(F.count(F.lit(1)).alias("_n"), *[F.stddev_pop(f"`{c}`").alias(f"_s{j}") for j, c in enumerate(z)])
    wanted = [F.struct(F.floor(u * F.col("_n")).cast("long").alias("_r"), (e * F.col(f"_s{j}") * F.pow("_n", F.lit(-0.2))).alias("_e")) for j, (u, e) in enumerate(zip(uniform, normal, strict=True))]
    table = slots.join(stats, "_pid").select("_pid", "_i", F.posexplode(F.array(*wanted)).alias("_j", "_w")).select("_pid", "_i", "_j", "_w.*")
    rows = cells(ranked(df.select(*ids, *z, "partition_id"), ids, seed).select(F.col("partition_id").alias("_pid"), F.col("rank").alias("_r"), *z), z, ["_pid", "_r"])
    return _gathered(table.join(rows, ["_pid", "_j", "_r"]), F.col("_x") + F.col("_e"), z)
