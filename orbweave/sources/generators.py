"""Made-up points and bodies, the same for the same seed however the rows are divided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(seed: int, axis: int) -> Column:
    """Uniform on [0, 1) by a hash of the id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(axis), "id"), 11).cast("double") / F.lit(float(1 << 53))


def uniform_points(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 42, places: int | None = None) -> DataFrame:
    at = lambda axis: F.lit(low) + _unit(seed, axis) * (high - low)
    return spark.range(n).select("id", *((F.round(at(i), places) if places is not None else at(i)).cast("float").alias(c) for i, c in enumerate("xyz")))


def uniform_bodies(spark: SparkSession, n: int = 10_000, side: float = 100.0, seed: int = 42) -> DataFrame:
    """Positions on [-side, side], masses on [0.5, 1.5], at rest."""
    points = uniform_points(spark, n, -side, side, seed)
    return points.select("*", (_unit(seed, 3) + 0.5).cast("float").alias("mass"), *(F.lit(0.0).cast("float").alias(c) for c in ("vx", "vy", "vz")))
