"""Numbers that depend on keys alone, never on the physical layout: hashed uniforms, normals and lattice quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fractional part of the golden ratio, the lattice's step between features.
GOLDEN = 0.6180339887498949


def uniforms(seed: int, *keys: Column | int) -> list[Column]:
    """Three numbers in [0, 1) from the keys, 40 bits each: parts of one md5 digest, which any SQL engine can compute."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.lit(str(k)) if isinstance(k, int) else k.cast("string") for k in keys]))
    return [F.conv(F.substring(h, 1 + 10 * part, 10), 16, 10).cast("double") * F.lit(2.0**-40) for part in range(3)]


def uniform(seed: int, *keys: Column | int) -> Column:
    """A number in [0, 1) from the keys."""
    return uniforms(seed, *keys)[0]


def normal(seed: int, *keys: Column | int) -> Column:
    """A standard normal number by Box and Muller's formula."""
    a, b, _ = uniforms(seed, *keys)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)


def epanechnikov(seed: int, *keys: Column | int) -> Column:
    """Epanechnikov noise from three uniforms: the second, where the third is the largest in size, else the third."""
    a, b, c = (2 * u - 1 for u in uniforms(seed, *keys))
    return F.when((F.abs(c) >= F.abs(b)) & (F.abs(c) >= F.abs(a)), b).otherwise(c)


def order_key(seed: int, ids: list[str]) -> Column:
    """A seeded order of rows that any SQL engine can compute."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def lattice(i: Column, n: Column, j: int) -> Column:
    """Rank-one lattice quantile of slot i of n for feature j."""
    x = (i + F.lit(0.5)) / n + F.lit(j * GOLDEN)
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x - F.floor(x)))


def probit(p: Column) -> Column:
    """Normal quantile through Winitzki's inverse error function (a = 0.147)."""
    x = 2 * p - 1
    log = F.log(1 - x * x)
    first = F.lit(2 / (math.pi * 0.147)) + log / 2
    return F.lit(math.sqrt(2)) * F.signum(x) * F.sqrt(F.sqrt(first * first - log / 0.147) - first)


#: Hart's rational approximation of the normal distribution's tail (table 5666), highest power first.
HART_OVER = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_UNDER = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_share(x: Column) -> Column:
    """The normal distribution function, to about 1e-15; beyond 7 it stays what it is there."""
    far = F.least(F.abs(x), F.lit(7.0))
    over, under = F.lit(HART_OVER[0]), F.lit(HART_UNDER[0])
    for c in HART_OVER[1:]:
        over = over * far + c
    for c in HART_UNDER[1:]:
        under = under * far + c
    tail = F.exp(-far * far / 2) * over / under
    return F.when(x > 0, 1 - tail).otherwise(tail)


def epanechnikov_quantile(u: Column) -> Column:
    """Inverse of the Epanechnikov distribution: the closed form that Newton's rounds approach, 2 sin(asin(2u - 1) / 3)."""
    return 2 * F.sin(F.asin(2 * u - 1) / 3)


def laplace_quantile(u: Column) -> Column:
    return F.when(u < 0.5, F.log(2 * u)).otherwise(-F.log(2 * (1 - u)))
