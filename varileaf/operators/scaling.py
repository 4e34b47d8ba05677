"""Fitted scaling of features: mean and deviation, or median and MAD; codes of categories; and back."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varileaf.operators.projection import PROJECTION, Projection, fit_projection

#: Makes the MAD of a normal distribution its deviation.
MAD_FACTOR = 1.4826
#: Categories a column may have; their codes are one expression.
MOST_CATEGORIES = 1000


#: Rows of which the driver takes the distinct values around a middle (a thousandth of them at most); more are narrowed down first.
MIDDLE_ROWS = 100_000_000
_NEAR = 2e-4


def medians(df: DataFrame, columns: list[Column], exact: bool = True) -> list[float | None]:
    """The columns' medians, nulls left out, NaN above all: exact with linear interpolation, or (exact=False) of a bounded-memory approximation.

    Exact ones lie between two approximate quantiles; the rows below are counted, and only values between are counted one by one.
    """
    named = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    if not exact:
        return [None if v is None else float(v) for v in named.agg(*[F.percentile_approx(c, 0.5, 10000) for c in named.columns]).first()]
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    ends = [0.5 - _NEAR, 0.5 + _NEAR]
    row = named.agg(*[f(c).alias(f"{k}{c}") for c in named.columns for k, f in (("n", F.count), ("r", lambda c: F.count(number(c))), ("q", lambda c: F.percentile_approx(number(c), ends, 10000)))]).first()
    return [_median(named.select(number(c).alias("x")).where("x is not null"), row[f"n{c}"], row[f"r{c}"], row[f"q{c}"]) for c in named.columns]


def _median(x: DataFrame, rows: int, real: int, ends: list[float] | None) -> float | None:
    """Of `rows` rows, of which `real` are numbers (x) with about these quantiles around the middle."""
    if not rows:
        return None
    low, high = (rows - 1) // 2, rows // 2
    if high >= real:
        return float("nan")
    if rows > real:  # NaN moves the middle up
        ends = [low / real - _NEAR, high / real + _NEAR]
        ends = x.agg(F.percentile_approx("x", [max(0.0, ends[0]), min(1.0, ends[1])], 10000)).first()[0]
    below, left, few = 0, real, real <= MIDDLE_ROWS
    while True:
        a, b = (F.lit(float(v)) for v in ends)
        side = F.when(F.col("x") < a, -1).when(F.col("x") > b, 1).otherwise(0)
        value = F.when(side == 0, F.col("x")) if few else F.lit(None).cast("double")
        found = x.groupBy(side.alias("side"), value.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most")).collect()
        under, inside, over = ([r for r in found if r.side == k] for k in (-1, 0, 1))
        first = below + sum(r.n for r in under)
        last = first + sum(r.n for r in inside)
        if high < first or low >= last:  # the quantiles missed the middle
            x, below, left = (x.where(F.col("x") < a), below, first - below) if high < first else (x.where(F.col("x") > b), last, sum(r.n for r in over))
        elif low < first or high >= last or few or ends[0] == ends[1]:
            runs = [(r.most, r.n) for r in under] + (sorted((r.v, r.n) for r in inside) if few else [(r.least, 1) for r in inside] + [(r.most, r.n - 1) for r in inside]) + [(r.least, r.n) for r in over]
            upto = below + np.cumsum([n for _, n in runs])
            p, q = (float(runs[int(np.searchsorted(upto, k, side="right"))][0]) for k in (low, high))
            return p if p == q else 0.5 * p + 0.5 * q
        else:
            few = left <= MIDDLE_ROWS or last - first == left  # rows that equal an end are no more values
            x, below, left = x.where((F.col("x") >= a) & (F.col("x") <= b)), first, last - first
        few = few or left <= MIDDLE_ROWS
        at = [(low - below) / left - _NEAR, (high - below) / left + _NEAR]
        ends = x.agg(F.percentile_approx("x", [max(0.0, min(1.0, q)) for q in at], 10000)).first()[0]


@dataclass
class Scaler:
    """z = (x - center) / scale for each feature; categories become codes first. With a projection of the categories, its column comes last."""

    features: list[str]
    kind: str = "std"
    categorical: list[str] = field(default_factory=list)
    exact: bool = True
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    projection: Projection | None = None

    @property
    def z_columns(self) -> list[str]:
        return [*[f"z_{c}" for c in self.features], *([PROJECTION] if self.projection else [])]

    def raw(self, name: str) -> Column:
        """A feature as a number; a category's code is its rank among the fitted labels, and an unknown label raises."""
        if name not in self.categorical:
            return F.col(f"`{name}`").cast("double")
        at = F.array_position(F.array(*[F.lit(x) for x in self.labels[name]]), F.col(f"`{name}`").cast("string"))
        return F.when(at > 0, (at - 1).cast("double")).otherwise(F.raise_error(F.concat(F.lit(f"unknown category in {name}: "), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("null")))).cast("double"))

    def fit(self, df: DataFrame) -> Scaler:
        """One aggregation for mean and deviation, medians() twice for median and MAD."""
        for c in self.categorical:
            found = df.select(F.col(f"`{c}`").cast("string").alias("v")).where("v is not null").distinct().limit(MOST_CATEGORIES + 1).collect()
            if len(found) > MOST_CATEGORIES:
                raise ValueError(f"{c} has more than {MOST_CATEGORIES} categories")
            self.labels[c] = sorted(r.v for r in found)
        raw = {c: self.raw(c) for c in self.features}
        std = [c for c in self.features if self.kind == "std" or c in self.categorical]
        mad = [c for c in self.features if c not in std]
        if std:
            row = df.agg(*[F.avg(raw[c]).alias(f"m{i}") for i, c in enumerate(std)], *[F.stddev_pop(raw[c]).alias(f"s{i}") for i, c in enumerate(std)]).first()
            for i, c in enumerate(std):
                self.center[c], self.scale[c] = float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 0.0) or 1.0
        if mad:
            middle = [float(x or 0.0) for x in medians(df, [raw[c] for c in mad], self.exact)]
            row = medians(df, [F.abs(raw[c] - F.lit(m)) for c, m in zip(mad, middle, strict=True)], self.exact)
            for c, m, deviation in zip(mad, middle, row, strict=True):
                self.center[c], self.scale[c] = m, MAD_FACTOR * float(deviation or 0.0) or 1.0
        return self

    def project(self, df: DataFrame, y: str) -> Scaler:
        """Adds the column that stands for all categories: what a shallow tree over their codes predicts of y."""
        if self.categorical:
            z = [self.z(c).alias(f"z_{c}") for c in self.categorical]
            self.projection = fit_projection(df.select(*z, F.col(f"`{y}`").alias("_y")), [f"z_{c}" for c in self.categorical], "_y")
        return self

    def z(self, name: str) -> Column:
        return (self.raw(name) - F.lit(self.center[name])) / F.lit(self.scale[name])

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The kept columns (all by default) and one z column for each feature, in one projection, and then that of the categories."""
        kept = df.columns if keep is None else keep
        out = df.select(*[F.col(f"`{c}`") for c in kept], *[self.z(c).alias(f"z_{c}") for c in self.features])
        return out.withColumn(PROJECTION, self.projection.column()) if self.projection else out

    def to_dict(self) -> dict:
        return {k: getattr(self, k) for k in ("features", "kind", "categorical", "center", "scale", "labels")} | {"projection": self.projection and self.projection.to_dict()}

    @classmethod
    def from_dict(cls, state: dict) -> Scaler:
        found = state.get("projection")
        return cls(**{**state, "projection": Projection.from_dict(found) if found else None})

    def restore(self, name: str, z: Column) -> Column:
        """A feature in its own unit; a category's code is rounded half to even and held in range."""
        x = z * F.lit(self.scale[name]) + F.lit(self.center[name])
        if name not in self.categorical:
            return x
        top = len(self.labels[name]) - 1
        code = F.greatest(F.lit(0), F.least(F.lit(top), F.bround(x, 0).cast("int")))
        return F.element_at(F.array(*[F.lit(v) for v in self.labels[name]]), code + 1)

    def inverse(self, df: DataFrame) -> DataFrame:
        done = set(self.z_columns)
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in done], *[self.restore(c, F.col(f"`z_{c}`")).alias(c) for c in self.features])


def bind(df: DataFrame, features: list[str]) -> DataFrame:
    """Checks that a table has the features; extra columns are reported."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df


def trimmed(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Only what is needed of an external table, with a warning for the columns that are left out."""
    extra = [c for c in df.columns if c not in features and c not in keep]
    if extra:
        warnings.warn(f"columns not used: {extra}", stacklevel=2)
    return bind(df, features).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *features])])
