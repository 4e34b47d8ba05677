"""Whitening of vectors by a one-sided Jacobi SVD of a triangular factor.

Every task compresses its rows block by block to a triangle R, by QR of the rows less the block's mean; triangles are stacked with one row for
the difference of their means and factored again, over all tasks in a tree. The last R, whose size is the square of the dimension
whatever the number of rows, comes to the driver. Plane rotations make its columns orthogonal: their lengths are the standard deviations
(times the root of the number of rows), the accumulated rotations are the components. The covariance itself, whose condition is the
square of R's, is never formed.

Rows are x = floor(1024 * entry) + SHIFT. With sums S = n*q + r, x - S/n is (x - q) - r/n, where x - q is an exact integer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.llm.common import map_arrow, materialize
from varileaf.llm.vectors import chosen, matrices, usable

SHIFT = 100_000
#: Entries of this size or more count as non-finite: their sums over a batch wouldn't fit a long.
MOST = 2.0**38
#: The triangles of all tasks are merged into at most so many, those into so many, and those into one.
TREE = (1024, 32, 1)
#: Entries of a block of rows that is factored at a time; it has four times as many rows as columns at least.
BLOCK = 1 << 18
SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """Number and sums of the rows, components in columns (largest deviation first), their standard deviations, and the covariance's trace.

    Components without deviation are left out.
    """

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    deviations: np.ndarray
    trace: float


@dataclass(frozen=True)
class Factor:
    """Number and sums of some rows, and R of these rows less their mean."""

    n: int
    sums: list[int]
    r: np.ndarray


def centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole parts and remainders of sums by n."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def factored(x: np.ndarray) -> Factor:
    sums = x.sum(axis=0).tolist()
    whole, rest = centre(len(x), sums)
    return Factor(len(x), sums, np.linalg.qr((x - whole) - rest / len(x), mode="r"))


def joined(a: Factor, b: Factor) -> Factor:
    """The factor of both's rows: the means' difference counts as one row of the weight that both have against each other."""
    apart = np.array([(s * b.n - t * a.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums, strict=True)])
    row = np.sqrt(a.n / (a.n + b.n) * b.n) * apart
    return Factor(a.n + b.n, [s + t for s, t in zip(a.sums, b.sums, strict=True)], np.linalg.qr(np.vstack((a.r, b.r, row)), mode="r"))


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of r's columns, falling, after plane rotations made them orthogonal, and the accumulated rotations in that order.

    A sweep meets each pair of columns once, in rounds of disjoint pairs that turn together.
    """
    d = r.shape[1]
    a, v = r.T.astype(np.float64), np.eye(d)  # a row here is a column of r
    half = -(-d // 2)
    ring = np.arange(2 * half)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(2 * half - 1):
            p, q = ring[:half], ring[half:][::-1]
            p, q = p[(p < d) & (q < d)], q[(p < d) & (q < d)]
            xx, yy, xy = (np.einsum("ij,ij->i", m, w) for m, w in ((a[p], a[p]), (a[q], a[q]), (a[p], a[q])))
            far = np.abs(xy) > np.finfo(float).eps * np.sqrt(xx) * np.sqrt(yy)
            if far.any():
                turned = True
                p, q, xx, yy, xy = p[far], q[far], xx[far], yy[far], xy[far]
                with np.errstate(over="ignore"):  # of columns of very unlike lengths: no turn
                    half_cot = (yy - xx) / (2 * xy)
                    t = np.where(half_cot < 0, -1.0, 1.0) / (np.abs(half_cot) + np.hypot(1, half_cot))
                c = (1 / np.hypot(1, t))[:, None]
                s = c * t[:, None]
                for m in (a, v):
                    m[p], m[q] = c * m[p] - s * m[q], s * m[p] + c * m[q]
            ring[1:] = np.roll(ring[1:], 1)
        if not turned:
            break
    lengths = np.linalg.norm(a, axis=1)
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[order].T


def dimension(rows: DataFrame) -> int:
    """The most frequent length of usable vectors, the larger of equals; 0 without any."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for frame in frames:
            for length, times in zip(*(x.tolist() for x in np.unique(usable(frame.column(1), MOST)[0], return_counts=True)), strict=True):
                seen[length] = seen.get(length, 0) + times
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (seen.keys(), seen.values())], names=["dims", "times"])

    found = map_arrow(rows, count, "dims long, times long").where("dims > 0").groupBy("dims").agg(F.sum("times").alias("times"))
    first = found.orderBy(F.desc("times"), F.desc("dims")).limit(1).collect()
    return first[0].dims if first else 0


_FACTOR = "part long, n long, sums array<decimal(38,0)>, r binary"


def _row(part: int, f: Factor) -> pa.RecordBatch:
    sums = pa.array([Decimal(s) for s in f.sums], pa.decimal128(38, 0))
    columns = [pa.array([part], pa.int64()), pa.array([f.n], pa.int64()), pa.ListArray.from_arrays([0, len(sums)], sums), pa.array([f.r.tobytes()])]
    return pa.RecordBatch.from_arrays(columns, names=["part", "n", "sums", "r"])


def _factors(rows: DataFrame, dims: int) -> DataFrame:
    """Each task's factor; part is the task's number."""
    height = max(4 * dims, BLOCK // dims)

    def factor(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (factored(x[a : a + height] + SHIFT) for _, x in matrices(frames, dims, MOST) for a in range(0, len(x), height))
        first = next(blocks, None)
        if first:
            yield _row(TaskContext.get().partitionId(), reduce(joined, blocks, first))

    return map_arrow(rows, factor, _FACTOR)


def _merged(factors: DataFrame, dims: int, into: int) -> DataFrame:
    """The factors with one `part` modulo `into` as one; a task holds two at a time."""

    def merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, None
        for frame in frames:
            for p, n, sums, r in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                one = Factor(n, [*map(int, sums)], np.frombuffer(r).reshape(-1, dims))
                if held and p != part:
                    yield _row(part, held)
                    held = None
                part, held = p, joined(held, one) if held else one
        if held:
            yield _row(part, held)

    dealt = factors.withColumn("part", F.col("part") % into).repartition("part").sortWithinPartitions("part")
    return map_arrow(dealt, merge, _FACTOR)


def fit(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> Whitening | None:
    """Components of the usable vectors of the most frequent length; None without any such vector."""
    rows = chosen(df, key, vector)
    dims = dimension(rows)
    if not dims:
        return None
    factors = _factors(rows, dims)
    for into in TREE:
        factors = _merged(factors, dims, into)
    (last,) = factors.collect()
    r = np.frombuffer(last.r).reshape(-1, dims)
    lengths, components = jacobi(r)
    kept = lengths > lengths[0] * dims * np.finfo(float).eps
    deviations = lengths / np.sqrt(last.n)
    return Whitening(last.n, tuple(map(int, last.sums)), components[:, kept], deviations[kept], float(np.square(deviations).sum()))


def transform(df: DataFrame, model: Whitening, components: int | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, deviation (sum over dimensions of (n*x - S)^2, exact) and whitened, of every usable vector of the model's dimension."""
    n, dims = model.n, len(model.sums)
    whole, rest = centre(n, model.sums)
    axes = model.components[:, :components] / model.deviations[:components]

    def white(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(frames, dims, MOST):
            y = x + SHIFT - whole
            z = (y - rest / n) @ axes
            if (float(np.abs(y).max()) + 1) ** 2 * n * n * dims < 2**62:
                deviation = pa.array(np.square(n * y - rest).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                sums = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in y.tolist()]
                deviation = pa.array([str(s) if s < 10**38 else None for s in sums], pa.string()).cast(pa.decimal128(38, 0))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([ids, deviation, flat], names=["vec_id", "deviation", "whitened"])

    return map_arrow(chosen(df, key, vector), white, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest entry in magnitude of the covariance of k whitened columns minus the identity."""
    w = [F.element_at("whitened", i + 1) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = white.agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(w)], *[F.sum(w[i] * w[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(sums[f"p{i}_{j}"] / n - sums[f"s{i}"] / n * sums[f"s{j}"] / n - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, components: int = 8, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every usable vector and component up to `components`.

    Left out are vectors that are null or hold a null, a non-finite entry or one of MOST or more, empty ones and those that haven't the most
    frequent length. Components without deviation aren't returned: a single row, or equal rows, have none. Repeated rows count
    as often as they occur; null ids stay; an empty table gives none; other columns are left out. A deviation that a long (38 digits in
    transform()) can't hold is null. What transform() makes is written once to the shared folder.
    """
    model = fit(df, vector, key)
    k = min(components, len(model.deviations)) if model else 0
    if not k:
        return df.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = materialize(transform(df, model, k, vector, key), "whitened")
    error = identity_error(white, model.n, k)
    explained = F.array(*[F.lit(float(d * d / model.trace)) for d in model.deviations[:k]])
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation as bigint)").alias("deviation"),
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
