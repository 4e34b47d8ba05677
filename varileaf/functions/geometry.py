"""Row-wise geometry of standardised features, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(columns: list[Column]) -> Column:
    return reduce(add, columns) if columns else F.lit(0.0)


def signed_sum(z: list[Column]) -> Column:
    """S: the sum of the features."""
    return total(z)


def square_sum(z: list[Column]) -> Column:
    """Q: the squared norm."""
    return total([c * c for c in z])


def cooperation(z: list[Column]) -> Column:
    """T = S^2 - Q, twice the sum of all pairwise products."""
    return signed_sum(z) * signed_sum(z) - square_sum(z)


def sign_deficit(z: list[Column]) -> Column:
    """A = |S| - sum |z|, zero where all signs agree."""
    return F.abs(signed_sum(z)) - total([F.abs(c) for c in z])


def minority_sign(z: list[Column]) -> Column:
    """The smaller of the positive and the negative parts."""
    zero = F.lit(0.0)
    return F.least(total([F.greatest(c, zero) for c in z]), total([F.greatest(-c, zero) for c in z]))


def magnitude_products(z: list[Column]) -> Column:
    """Half of the squared 1-norm less the squared 2-norm: the sum of |z_i||z_j| over pairs."""
    norm = total([F.abs(c) for c in z])
    return (norm * norm - square_sum(z)) / 2


def third_symmetric(z: list[Column]) -> Column:
    """Third elementary symmetric sum, from power sums."""
    s, q, cubes = signed_sum(z), square_sum(z), total([c * c * c for c in z])
    return (s * s * s + 2 * cubes - 3 * q * s) / 6


def nearest_label(value: Column, labels: list[float]) -> Column:
    """The label nearest to a value; of two equally near the smaller."""
    known = F.array(*[F.lit(float(x)) for x in sorted(labels)])
    return F.array_min(F.transform(known, lambda c: F.struct(F.abs(value - c).alias("d"), c.alias("v"))))["v"]
