"""Samples of tables with an id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seed, multiplier and increment of the linear congruential generator.
LCG_SEED = 0x123456789ABCDEF
LCG_A, LCG_C = 6364136223846793005, 1442695040888963407


def stride_sample(points: DataFrame, n: int, most: int, ordinal: str = "id") -> DataFrame:
    """At most ``most`` rows at equal steps of a dense ordinal from 0 over ``n`` rows."""
    step = max(1, n // most)
    return points.where((F.col(ordinal) % step == 0) & (F.floor(F.col(ordinal) / step) < most))


def every_nth(points: DataFrame, step: int = 10, ordinal: str = "id") -> DataFrame:
    return points.where(F.col(ordinal) % step == 0)


def prefix(points: DataFrame, n: int, ordinal: str = "id") -> DataFrame:
    """The first ``n`` rows of a dense ordinal from 0."""
    return points.where(F.col(ordinal) < n)


def lcg_values(count: int, below: int, seed: int = LCG_SEED) -> list[int]:
    """Draws with replacement; the state is advanced first and its upper 31 bits are used."""
    out, state = [], seed
    for _ in range(count):
        state = (state * LCG_A + LCG_C) % 2**64
        out.append((state >> 33) % below)
    return out


def lcg_sample(points: DataFrame, count: int, n: int, ordinal: str = "id", seed: int = LCG_SEED) -> DataFrame:
    """``count`` draws of rows 0 to n-1 with replacement, with ``draw``, their number."""
    drawn = points.sparkSession.createDataFrame(list(enumerate(lcg_values(count, max(1, n), seed))), "draw long, at long")
    return points.join(F.broadcast(drawn), F.col(ordinal) == F.col("at")).drop("at")  # count rows, a parameter


def random_sample(points: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """min(most, n) rows without replacement: those with the least hashes; a threshold leaves about twice as many to sort."""
    n, level = points.count(), 1 << 30
    h = F.xxhash64(F.lit(seed), *points.columns)
    some = points.where(F.pmod(h, F.lit(level)) < 2 * most * level // max(1, n)) if n > 2 * most else points
    if n > 2 * most and some.limit(most).count() < most:
        some = points
    return points if n <= most else some.orderBy(F.pmod(h, F.lit(level)), h).limit(most)


def hashed_sample(points: DataFrame, most: int, key: str = "id") -> DataFrame:
    """About ``most`` rows by a hash of the key, all if there are no more; the same ones however the table is divided."""
    n = points.count()
    level = 1 << 30
    return points if n <= most else points.where(F.pmod(F.xxhash64(key), F.lit(level)) < max(1, most * level // n))
