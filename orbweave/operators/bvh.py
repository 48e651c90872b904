"""Binary hierarchies of bounding boxes, built level by level with aggregations.

Primitives are rows (prim_id, lx, ly, lz, hx, hy, hz). A node is a string of 0 and 1 from the root. It is divided at the
middle of its longest axis by the primitives' centres, unless it has at most ``LEAF`` primitives or all fall on one side.
The joins of this library prune by cells and bounds and need no tree; this is for those who want the tree itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.geometry import Geometry
from orbweave.plans.cuts import Cuts

LEAF = 2
_SIDES = tuple(s + c for s in "lh" for c in "xyz")


@dataclass(frozen=True)
class Hierarchy:
    #: key, level, n, lx … hz, is_leaf
    nodes: DataFrame
    #: key, prim_id: each primitive with its leaf
    members: DataFrame
    levels: int


def boxes(prims: DataFrame, geometry: Geometry, prim_id: str = "prim_id") -> DataFrame:
    """Primitives' bounding boxes by a geometry."""
    box = geometry.bounds()
    return prims.select(F.col(prim_id).alias("prim_id"), *(c.alias(n) for c, n in zip((*box.low, *box.high), _SIDES)))


def bounds_by(prims: DataFrame, *keys: str) -> DataFrame:
    """keys, n and the box around the boxes of each group."""
    return prims.groupBy(*keys).agg(F.count("*").alias("n"), *((F.min if s[0] == "l" else F.max)(s).alias(s) for s in _SIDES))


def build(prims: DataFrame, leaf: int = LEAF, cuts: Cuts | None = None) -> Hierarchy:
    """A job per level; what is in leaves leaves the loop. No primitives give no nodes."""
    cuts = cuts or Cuts(prims.sparkSession)
    active, nodes, members, level = prims.select("prim_id", *_SIDES).withColumn("key", F.lit("")), None, None, 0
    while True:
        wide = {c: F.col("h" + c) - F.col("l" + c) for c in "xyz"}
        axis = F.when((wide["z"] > wide["y"]) & (wide["z"] > wide["x"]), "z").when(wide["y"] > wide["x"], "y").otherwise("x")
        half = F.lit(0.5).cast("float")
        middle = lambda p: F.when(F.col("axis") == "z", (F.col(p + "lz") + F.col(p + "hz")) * half).when(F.col("axis") == "y", (F.col(p + "ly") + F.col(p + "hy")) * half).otherwise((F.col(p + "lx") + F.col(p + "hx")) * half)
        found = cuts.cut(bounds_by(active, "key").withColumn("axis", axis))
        own = found.select("key", "n", "axis", *(F.col(s).alias("n" + s) for s in _SIDES))
        told = cuts.cut(active.join(own, "key").withColumn("left", middle("") < middle("n")))
        # how many primitives of a node go left; none or all make it a leaf
        lefts = told.groupBy("key").agg(F.sum(F.col("left").cast("bigint")).alias("lefts"))
        here = cuts.cut(found.join(lefts, "key").select("key", F.lit(level).alias("level"), "n", *_SIDES, ((F.col("n") <= leaf) | (F.col("lefts") == 0) | (F.col("lefts") == F.col("n"))).alias("is_leaf")))
        nodes = here if nodes is None else nodes.unionByName(here)
        placed = told.join(here.select("key", "is_leaf"), "key")
        settled = placed.where("is_leaf").select("key", "prim_id")
        members = settled if members is None else members.unionByName(settled)
        if not here.where("not is_leaf").limit(1).count():
            return Hierarchy(nodes, members, level + 1)
        active = placed.where("not is_leaf").select("prim_id", *_SIDES, F.concat("key", F.when(F.col("left"), "0").otherwise("1")).alias("key"))
        level += 1
