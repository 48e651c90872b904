"""Octrees over bodies (id, x, y, z, mass), built level by level with aggregations.

A cell is a string of octant digits from the root; x adds 1, y 2, z 4 where the body isn't below the centre. A
cell is a leaf if it has at most ``leaf_size`` bodies or is narrower than ``LEAST_WIDTH``. Bodies of leaves leave
the loop, so each level shuffles only what is still divided.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.ordering import bounding_box
from orbweave.plans.cuts import Cuts

LEAF_SIZE = 128
LEAST_WIDTH = 1e-5


@dataclass(frozen=True)
class Octree:
    #: key, level, width, n, mass, com_x, com_y, com_z, is_leaf
    nodes: DataFrame
    #: key, id, x, y, z, mass: each body with its leaf
    members: DataFrame
    levels: int


def build(bodies: DataFrame, leaf_size: int = LEAF_SIZE, cuts: Cuts | None = None) -> Octree:
    """A job per level. No bodies give no nodes; a cell whose masses sum to 0 has its centre of mass at the origin."""
    cuts = cuts or Cuts(bodies.sparkSession)
    box = bounding_box(bodies).first()
    low, high = [box[f"min_{c}"] for c in "xyz"], [box[f"max_{c}"] for c in "xyz"]
    found = low[0] is not None
    center = [(a + b) * 0.5 if found else 0.0 for a, b in zip(low, high)]
    width = max(float(b - a) for a, b in zip(low, high)) if found else 0.0
    active = bodies.select("id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "mass")), F.lit("").alias("key"), *(F.lit(float(m)).alias("c" + c) for m, c in zip(center, "xyz")))
    nodes = members = None
    level = 0
    while True:
        moment = lambda c: F.when(F.col("mass") != 0, F.try_divide(F.col("s" + c), F.col("mass"))).otherwise(0.0).alias("com_" + c)
        summed = active.groupBy("key").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), *(F.sum(F.col("mass") * F.col(c)).alias("s" + c) for c in "xyz"))
        here = summed.select("key", F.lit(level).alias("level"), F.lit(width).alias("width"), "n", "mass", *(moment(c) for c in "xyz"), ((F.col("n") <= leaf_size) | F.lit(width < LEAST_WIDTH)).alias("is_leaf"))
        here = cuts.cut(here)
        nodes = here if nodes is None else nodes.unionByName(here)
        told = cuts.cut(active.join(here.select("key", "is_leaf"), "key"))
        leaf = told.where("is_leaf").select("key", "id", "x", "y", "z", "mass")
        members = leaf if members is None else members.unionByName(leaf)
        rest = told.where("not is_leaf")
        if not here.where("not is_leaf").limit(1).count():
            return Octree(nodes, members, level + 1)
        upper = {c: (F.col(c) >= F.col("c" + c)) for c in "xyz"}
        digit = sum((F.when(upper[c], v).otherwise(0) for c, v in (("y", 2), ("z", 4))), F.when(upper["x"], 1).otherwise(0))
        active = rest.select("id", "x", "y", "z", "mass", F.concat("key", digit.cast("string")).alias("key"), *(F.when(upper[c], F.col("c" + c) + width / 4).otherwise(F.col("c" + c) - width / 4).alias("c" + c) for c in "xyz"))
        width, level = width / 2, level + 1


def octants(tree: Octree, level: int = 1) -> DataFrame:
    """(key, n): how many bodies each cell of a level has."""
    return tree.nodes.where(F.col("level") == level).select("key", "n")


def ropes(tree: Octree) -> DataFrame:
    """(key, index, next_index, rope, is_leaf): places in depth-first order, and the place after each node's subtree.

    Before a node come its ancestors and the subtrees of its and its ancestors' earlier siblings, so places are sums over a
    key's prefixes and no task sorts all nodes.
    """
    prefixes = tree.nodes.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("q"))
    sizes = prefixes.groupBy("q").agg(F.count("*").alias("size"))
    parent = F.when(F.length("q") > 0, F.expr("substring(q, 1, length(q) - 1)"))
    earlier = F.sum("size").over(Window.partitionBy("parent").orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.withColumn("parent", parent).select("q", "size", F.coalesce(earlier, F.lit(0)).alias("before"))
    places = prefixes.join(before, "q").groupBy("key").agg((F.sum("before") + F.length(F.col("key"))).cast("bigint").alias("index"), F.sum(F.when(F.col("q") == F.col("key"), F.col("size"))).alias("size"))
    return places.join(tree.nodes.select("key", "is_leaf"), "key").select("key", "index", (F.col("index") + 1).alias("next_index"), (F.col("index") + F.col("size")).alias("rope"), "is_leaf")
