"""Connected components of a graph that no machine can hold: alternating large-star and small-star rounds.

Each round is two aggregations (the least neighbour of every node) and two joins of the edges with them. The
least neighbours are written before they are joined, so that both sides of a join are plain shuffles, of which
Spark splits those of nodes with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Cuts


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("s")).first()
    return row["n"], row["x"], row["s"]


def components(edges: DataFrame, cuts: Cuts) -> DataFrame:
    """(node, root) for every node with an edge, but for the roots themselves; a root is the least node of its component.

    ``edges`` has two columns of one type; loops and repeated edges are allowed, rows with a null are ignored,
    and no edges give no rows.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = cuts.cut(pairs)
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cuts.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cuts.cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        below = cuts.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(below, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cuts.cut(moved.union(below.select("u", F.col("m").alias("v"))).distinct())
        for table in (now, least, large, below):
            cuts.drop(table)
        before, state, now = state, _state(small), small
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
