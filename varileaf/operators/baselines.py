"""Other reducers and generators to compare with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.functions import draws
from varileaf.operators import generate
from varileaf.operators.neighbours import squared_distances
from varileaf.operators.select import farthest, ranked

#: Rows that the two driver-side reducers look at; more are sampled by hash, as they need all pairs.
POOL = 5_000


def random_rows(df: DataFrame, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded order of their ids."""
    return df.withColumn("_k", draws.order_key(seed, ids)).orderBy("_k", *ids).limit(n).drop("_k")


def stratified_rows(df: DataFrame, ids: list[str], y: str, ratio: float, bins: int = 20, seed: int = 42) -> DataFrame:
    """A share of each class, or of each of `bins` quantile ranges where y has more than 20 values; one row of each at least."""
    values = df.select(y).distinct().limit(21).count()
    if values <= 20:
        marked = df.withColumn("_g", F.col(y).cast("string"))
    else:
        cuts = df.agg(F.percentile_approx(y, [i / bins for i in range(1, bins)], 10000)).first()[0]
        marked = df.withColumn("_g", sum(((F.col(y) > c).cast("int") for c in sorted(set(cuts))), F.lit(0)).cast("string"))
    sizes = marked.groupBy("_g").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * ratio)).alias("_b"))
    return ranked(marked, ids, seed, "_g").join(F.broadcast(sizes), "_g").where("rank < _b").drop("_g", "_b", "rank")


def _pool(df: DataFrame, ids: list[str], z: list[str], seed: int):
    frame = random_rows(df.select(*ids, *z), ids, POOL, seed).toPandas().sort_values(ids, kind="stable")
    return frame, frame[z].to_numpy(float)


def _joined(df: DataFrame, ids: list[str], frame, at) -> DataFrame:
    chosen = df.sparkSession.createDataFrame(frame.iloc[np.asarray(at)][ids].assign(selection_rank=range(len(at))))
    return df.join(chosen, ids)


def kennard_stone(df: DataFrame, ids: list[str], z: list[str], n: int, seed: int = 42) -> DataFrame:
    """The farthest pair, then always the row farthest from all chosen ones, among a pool of at most POOL rows."""
    frame, x = _pool(df, ids, z, seed)
    first = int(squared_distances(x, x).max(1).argmax()) if len(x) else 0
    return _joined(df, ids, frame, farthest(x, min(n, len(x)), first))


def pivoted_qr(df: DataFrame, ids: list[str], z: list[str], n: int, seed: int = 42) -> DataFrame:
    """Rows in the order in which pivoted orthogonalisation takes them, among a pool of at most POOL rows."""
    frame, x = _pool(df, ids, z, seed)
    rest, order = x.copy(), []
    for _ in range(min(n, len(x))):
        norms = (rest * rest).sum(1)
        norms[order] = -1
        at = int(norms.argmax())
        order.append(at)
        if norms[at] > 1e-12:
            unit = rest[at] / np.sqrt(norms[at])
            rest -= np.outer(rest @ unit, unit)
    return _joined(df, ids, frame, order)


def global_generator(df: DataFrame, ids: list[str], z: list[str], n: int, name: str, seed: int = 42) -> DataFrame:
    """A generation strategy over the table as one partition: copula, mixture, bootstrap noise or interpolation."""
    return generate.generate(df.withColumn("partition_id", F.lit(0)), ids, z, {0: n}, name, seed=seed)
