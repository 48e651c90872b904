"""Small programs over rays, as steps that become one plan.

A program runs over rows of rays with their hits. ``Trace`` finds the hits and branches on whether a ray has any;
the other steps act on the rows of the branch they are in. A step maps a DataFrame to a DataFrame, so that
Catalyst sees one plan; there is no interpreter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators import rays as R


@dataclass(frozen=True)
class Ignore:
    """Drops hits for which the condition is true."""

    condition: Column

    def run(self, rows: DataFrame) -> DataFrame:
        return rows.where(~F.coalesce(self.condition, F.lit(False)))


@dataclass(frozen=True)
class Terminate:
    """Keeps each ray's hits up to the first, in the order of (t, prim_id), for which the condition is true."""

    condition: Column

    def run(self, rows: DataFrame) -> DataFrame:
        return R.any_hit(rows, terminate=F.coalesce(self.condition, F.lit(False))).drop("ended")


@dataclass(frozen=True)
class Update:
    """Sets a payload column; ``running`` makes it the running sum over the ray's hits in their order."""

    name: str
    value: Column
    running: bool = False

    def run(self, rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("ray_id").orderBy("t", "prim_id").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(self.name, F.sum(self.value).over(order) if self.running else self.value)


@dataclass(frozen=True)
class Push:
    """One row per ray: the first ``cap`` values in the order of (t, prim_id), and how many there were."""

    value: Column
    cap: int
    name: str = "pushed"

    def run(self, rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("ray_id").orderBy("t", "prim_id"))
        ranked = rows.select("ray_id", self.value.alias("v"), rank.alias("k"), F.count("*").over(Window.partitionBy("ray_id")).alias("n"))
        kept = ranked.where(F.col("k") <= self.cap).groupBy("ray_id")
        return kept.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias(self.name), F.max("n").alias("n"))


@dataclass(frozen=True)
class If:
    """Rows for which the condition is true take one branch, the others (nulls among them) the other."""

    condition: Column
    then: Sequence = ()
    otherwise: Sequence = ()

    def run(self, rows: DataFrame) -> DataFrame:
        met = F.coalesce(self.condition, F.lit(False))
        return Block(self.then).run(rows.where(met)).unionByName(Block(self.otherwise).run(rows.where(~met)), allowMissingColumns=True)


@dataclass(frozen=True)
class Block:
    steps: Sequence = ()

    def run(self, rows: DataFrame) -> DataFrame:
        for step in self.steps:
            rows = step.run(rows)
        return rows


@dataclass(frozen=True)
class Sql:
    """Any SELECT over ``{rows}``."""

    text: str

    def run(self, rows: DataFrame) -> DataFrame:
        return rows.sparkSession.sql(self.text, rows=rows)


@dataclass(frozen=True)
class Trace:
    """Rays against geometries: the hits go through ``on_hit``, the rays without any, with null prim_id and t, through ``on_miss``."""

    geometry: object
    on_hit: Sequence = field(default=())
    on_miss: Sequence = field(default=())
    prim_id: str = "prim_id"

    def run(self, rays: DataFrame, prims: DataFrame) -> DataFrame:
        hits = R.trace(rays, prims, self.geometry, self.prim_id)
        missed = rays.select("ray_id").join(hits.select("ray_id").distinct(), "ray_id", "left_anti")
        missed = missed.select("ray_id", F.lit(None).cast("bigint").alias("prim_id"), F.lit(None).cast("double").alias("t"))
        return Block(self.on_hit).run(hits).unionByName(Block(self.on_miss).run(missed), allowMissingColumns=True)
