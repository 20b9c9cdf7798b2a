"""Distances and the scalar kernels of seeding and refinement, as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def squared_distance(x: Column | str, y: Column | str) -> Column:
    """The sum over dimensions, in order, of squared differences of two arrays."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def distance(x: Column | str, y: Column | str) -> Column:
    return F.sqrt(squared_distance(x, y))


def squared_distance_to(x: Column, point: Sequence[float]) -> Column:
    """To a literal point, unrolled so that it stays in whole-stage code."""
    total = F.lit(0.0)
    for j, v in enumerate(point):
        gap = x[j] - F.lit(float(v))
        total = total + gap * gap
    return total


def adjusted_ss(ss: Column, n: Column, adjustment: float) -> Column:
    """Sum of squares over n to the power 1 - adjustment."""
    return ss / F.pow(n, F.lit(1.0 - adjustment))


def midpoint(left: Column, right: Column) -> Column:
    return left + (right - left) / 2


def loss_multiplier(n: Column) -> Column:
    """n / (n - 1); of a cluster that must not lose its last member, a huge number."""
    return F.when(n > 1, n / (n - 1)).otherwise(F.lit(1e30))


def gain_multiplier(n: Column) -> Column:
    return n / (n + 1)


def register(spark: SparkSession) -> None:
    """sq_dist(x, y) and nearest_center(x, array of centres) for SQL texts, as SQL functions that Catalyst inlines."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION sq_dist(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE "
        "RETURN aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION nearest_center(x ARRAY<DOUBLE>, centers ARRAY<ARRAY<DOUBLE>>) RETURNS INT "
        "RETURN array_min(transform(centers, (c, i) -> struct(aggregate(zip_with(x, c, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v) AS d2, i AS cid))).cid"
    )
