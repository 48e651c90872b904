"""Results as files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.neighbours import neighbour_lists


def neighbour_lines(pairs: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(qid, value) with lines ``Q{qid}:[id, id]``; with ``queries`` (a column qid) also of those without neighbours."""
    lists = neighbour_lists(pairs)
    if queries is not None:
        lists = queries.select("qid").join(lists, "qid", "left")
    ids = F.concat_ws(", ", F.transform(F.coalesce("ids", F.array().cast("array<bigint>")), lambda i: i.cast("string")))
    return lists.select("qid", F.format_string("Q%d:[%s]", "qid", ids).alias("value"))


def write_neighbours(pairs: DataFrame, path: str, queries: DataFrame | None = None) -> None:
    """Text files of ``neighbour_lines`` in the order of queries."""
    neighbour_lines(pairs, queries).orderBy("qid").select("value").write.mode("overwrite").text(path)


def write_points(points: DataFrame, path: str) -> None:
    points.select("x", "y", "z").write.mode("overwrite").csv(path)


def write_points_binary(points: DataFrame, path: str) -> None:
    """One file of little-endian records of four 32-bit floats, the last one 0, in the order of the rows, which pass through the driver in blocks."""
    jvm, session = points.sparkSession.sparkContext._jvm, points.sparkSession.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(session.hadoopConfiguration()).create(where, True)
    try:
        held: list[tuple] = []
        for row in points.select("x", "y", "z", F.lit(0.0).cast("float")).toLocalIterator():
            held.append(tuple(row))
            if len(held) == 1 << 16:
                out.write(bytearray(np.array(held, "<f4").tobytes()))
                held = []
        out.write(bytearray(np.array(held, "<f4").tobytes()))
    finally:
        out.close()


def summary(pairs: DataFrame, n_queries: int, k: int, name: str, milliseconds: float) -> DataFrame:
    """One row: what was searched, how long it took, and how many neighbours were found."""
    return pairs.agg(F.count("*").alias("total_neighbours")).select(F.lit(name).alias("path"), F.lit(n_queries).cast("bigint").alias("nq"), F.lit(k).cast("bigint").alias("k"), F.lit(float(milliseconds)).alias("ms"), "total_neighbours")
