"""Comparisons of neighbour lists and forces with known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.plans.cuts import Cuts

CLOSE = 1e-5


def matches(found: DataFrame, truth: DataFrame, atol: float = CLOSE) -> DataFrame:
    """(qid, same_ids, ok): equal ids at all ranks, or as many neighbours and none farther than the truth's last plus ``atol``.

    Both are (qid, rank, id, d2), and each is read once.
    """
    sides = found.select("qid", "rank", "id", F.lit(1).alias("f"), F.lit(0).alias("t"), F.col("d2").alias("d"), F.lit(None).alias("td"))
    sides = sides.unionByName(truth.select("qid", "rank", "id", F.lit(0).alias("f"), F.lit(1).alias("t"), F.lit(None).alias("d"), F.col("d2").alias("td")))
    # dealt by query once, which serves both groupings
    met = sides.repartition("qid").groupBy("qid", "rank", "id").agg(F.sum("f").alias("f"), F.sum("t").alias("t"), F.max("d").alias("d"), F.max("td").alias("td"))
    out = met.groupBy("qid").agg(F.sum("f").alias("n"), F.sum("t").alias("true_n"), F.sum(F.col("f") * F.col("t")).alias("equal"), F.sqrt(F.max("d")).alias("far"), F.sqrt(F.max("td")).alias("true_far")).where("true_n > 0")
    same_ids = F.coalesce((F.col("equal") == F.col("true_n")) & (F.col("n") == F.col("true_n")), F.lit(False))
    near = F.coalesce((F.col("n") == F.col("true_n")) & (F.col("far") <= F.col("true_far") + atol), F.lit(False))
    return out.select("qid", same_ids.alias("same_ids"), (same_ids | near).alias("ok"))


def match_ratio(found: DataFrame, truth: DataFrame, atol: float = CLOSE) -> DataFrame:
    """One row: matching queries, all queries and their ratio (1 for none)."""
    return matches(found, truth, atol).agg(F.coalesce(F.sum(F.col("ok").cast("bigint")), F.lit(0)).cast("bigint").alias("matching"), F.count("*").alias("queries")).withColumn("ratio", F.coalesce(F.try_divide(F.col("matching").cast("double"), F.col("queries").cast("double")), F.lit(1.0)))


def close_distances(found: DataFrame, truth: DataFrame, atol: float = CLOSE, rtol: float = CLOSE) -> DataFrame:
    """(qid, ok): the distances at every rank are as near as |a - b| <= atol + rtol * |b|."""
    a, b = found.select("qid", "rank", F.sqrt("d2").alias("a")), truth.select("qid", "rank", F.sqrt("d2").alias("b"))
    return a.join(b, ["qid", "rank"], "full").groupBy("qid").agg(F.min(F.coalesce(F.abs(F.col("a") - F.col("b")) <= atol + rtol * F.abs(F.col("b")), F.lit(False))).alias("ok"))


def count_ok(found: DataFrame, n_queries: int, k: int) -> bool:
    return found.count() == n_queries * k


def force_error(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: both totals of magnitudes and their relative difference."""
    from orbweave.operators.nbody import total_force

    a, b = total_force(found).select(F.col("total_force").alias("found")), total_force(truth).select(F.col("total_force").alias("truth"))
    return a.join(F.broadcast(b)).withColumn("error", F.try_divide(F.abs(F.col("found") - F.col("truth")), F.col("truth")))


def failures(found: DataFrame, truth: DataFrame, most: int = 3) -> DataFrame:
    """The rows of the first queries that don't match, with both sides' ids and distances."""
    cuts = Cuts(found.sparkSession)
    # the few queries first, so that neither side is sorted or joined as a whole
    bad = F.broadcast(cuts.cut(matches(found, truth).where(~F.col("ok")).orderBy("qid").limit(most).select("qid")))
    a, b = found.select("qid", "rank", "id", "d2"), truth.select("qid", "rank", F.col("id").alias("true_id"), F.col("d2").alias("true_d2"))
    a, b = (side.join(bad, "qid", "left_semi") for side in (a, b))
    return a.join(b, ["qid", "rank"], "full").orderBy("qid", "rank")
