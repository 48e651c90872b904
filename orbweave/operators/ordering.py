"""Bounding boxes and orders along the Morton curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import morton
from orbweave.plans.cuts import Cuts, fresh


def bounding_box(points: DataFrame) -> DataFrame:
    """One row: the least and the greatest of each axis; nulls if there are no points."""
    return points.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"))


def morton_codes(points: DataFrame, isotropic: bool = False) -> DataFrame:
    """The points with ``code``. Each axis is scaled by its own extent; with ``isotropic`` all by the largest."""
    box = bounding_box(points)  # one row, so it is sent to every task
    extent = {c: F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"}
    if isotropic:
        extent = dict.fromkeys("xyz", F.greatest(*extent.values()))
    code = morton.code(*(morton.cell(F.col(c), F.col(f"min_{c}"), extent[c]) for c in "xyz"))
    return points.join(F.broadcast(box)).select(*points.columns, code.alias("code"))


def morton_sorted(points: DataFrame, isotropic: bool = False) -> DataFrame:
    """The points in order of (code, id) over the whole table, dealt by ranges of the code."""
    return morton_codes(points, isotropic).orderBy("code", "id")


def morton_ranked(points: DataFrame, isotropic: bool = False) -> DataFrame:
    """``morton_codes`` with ``position``, from 0 in order of (code, id).

    Points are dealt by ranges of (code, id), so many of one code are no hot task, and sorted within them; a point's
    position is its place in its range and the sizes of the ranges before.
    """
    cuts = Cuts(points.sparkSession)
    coded = morton_codes(points, isotropic)
    at, part, start = (fresh(n, coded) for n in ("at", "part", "start"))
    dealt = coded.repartitionByRange("code", "id").sortWithinPartitions("code", "id").withColumn(at, F.monotonically_increasing_id())
    dealt = cuts.cut(dealt.withColumn(part, F.shiftright(at, 33)))
    total, starts = 0, []
    for p, n in sorted(tuple(r) for r in dealt.groupBy(part).count().collect()):  # a row per partition
        starts.append((p, total))
        total += n
    offsets = points.sparkSession.createDataFrame(starts, f"{part} long, {start} long")
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(offsets), part).select(*coded.columns, (F.col(start) + place).alias("position"))
